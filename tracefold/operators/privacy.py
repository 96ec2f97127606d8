"""Who may see what: scopes, redaction by token, erasure, audits."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.outcomes import settle
from tracefold.sources.log import child_envelope

TOKEN_PREFIX = "tok_"
TOKEN_PATTERN = "^tok_[A-Za-z0-9]{1,32}_[0-9a-f]{64}$"


def scope_gate(log: DataFrame, required: str, scopes: Column | None = None, node: str = "scope_gate") -> tuple[DataFrame, DataFrame]:
    """(log rows whose identity holds the grant, ``Failed`` rows for the others).

    A refusal is a row like any other failure: caused by the refused one, with its payload as input and the
    missing grant as reason.  The log is read once.
    """
    held = F.array_contains(F.col("identity.scopes") if scopes is None else scopes, required)
    edge = F.concat(F.lit("Failed<"), F.col("edge"), F.lit(">"))
    body = [F.col("payload").alias("input")] if "payload" in log.columns else []
    failed = F.struct(*child_envelope(node, edge, F.lit(None).cast("string")),
                      F.struct(*body, F.lit(f"missing scope {required}").alias("reason")).alias("payload"))
    return settle(log, held, F.struct(*[F.col(f"`{c}`") for c in log.columns]), failed, "scope-gate")


def scope_narrow(df: DataFrame, declared: Iterable[str], edges: Mapping[str, str]) -> DataFrame:
    """Only the fields named by ``verb:Edge:field`` entries, never the whole object.

    ``edges`` maps an edge name to the struct column that holds it.
    """
    picked = []
    for entry in declared:
        verb, edge, field = entry.split(":")
        if verb == "read":
            picked.append(F.col(f"{edges[edge]}.{field}").alias(field))
    return df.select(*picked)


def grant_audit(log: DataFrame, declared: DataFrame, scopes: str = "identity.scopes") -> DataFrame:
    """Grants used but not declared, and declared but never used."""
    used = log.select(F.explode(scopes).alias("scope")).distinct()
    known = declared.select("scope").distinct()
    return (used.join(known, "scope", "left_anti").withColumn("finding", F.lit("undeclared"))
            .unionByName(known.join(used, "scope", "left_anti").withColumn("finding", F.lit("unused"))))


def scope_rows(df: DataFrame, entitlement: DataFrame, on: list[str]) -> DataFrame:
    """Filter to the identity once, at entry."""
    return df.join(entitlement.select(*on).distinct(), on, "left_semi")


def exit_filter(df: DataFrame, grants: DataFrame, on: list[str]) -> DataFrame:
    """Rows that a principal may receive: (edge, principal) pairs are granted."""
    return df.join(grants.select(*on).distinct(), on, "left_semi")


# -- redaction --------------------------------------------------------------

@dataclass(frozen=True)
class Key:
    """A secret for tokens and its public name, which every token made with it carries."""

    secret: str
    name: str = "k1"

    def __post_init__(self):
        if not re.fullmatch("[A-Za-z0-9]{1,32}", self.name):
            raise ValueError(f"a key's name is letters and digits, not {self.name!r}")

    def pads(self) -> tuple[bytes, bytes]:
        """The inner and outer key blocks of HMAC-SHA256 (RFC 2104)."""
        raw = self.secret.encode()
        block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
        return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def mac(message: Column, key: Key) -> Column:
    """HMAC-SHA256 of a binary column, as lower-case hex."""
    inner, outer = (F.lit(bytearray(pad)) for pad in key.pads())
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def prefixed(*parts: Column) -> Column:
    """The parts one after the other, each behind its number of bytes: different parts never give the same bytes."""
    texts = [p.cast("string") for p in parts]
    return F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]).cast("binary")


def token(field: str, value: Column, key: Key | str) -> Column:
    """Deterministic token of one value under a key, ``tok_<key name>_<hex>``; null stays null."""
    key = Key(key) if isinstance(key, str) else key
    return F.when(value.isNotNull(), F.concat(F.lit(f"{TOKEN_PREFIX}{key.name}_"), mac(prefixed(F.lit(field), value), key)))


def redact(df: DataFrame, fields: Iterable[str], salt: Key | str,
           namespaces: Mapping[str, str] | None = None, subject: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table with tokens, token map).  The map stays in the caller's zone.

    Fields sharing a namespace share tokens, which allows equality joins.  ``salt`` is the key; a new key gives new tokens, and
    those made with an older one still resolve while their map rows are kept, since each names its key.
    With ``subject`` (a column that names whose data a row is) the map has a row
    per subject, so that one subject's values can go and equal ones of others stay.
    """
    fields = list(fields)
    space = {f: (namespaces or {}).get(f, f) for f in fields}
    redacted = df.withColumns({f: token(space[f], F.col(f), salt) for f in fields})
    entries = F.array(*[F.struct(token(space[f], F.col(f), salt).alias("token"), F.lit(space[f]).alias("field"),
                                 F.col(f).cast("string").alias("value"),
                                 *([] if subject is None else [F.col(subject).alias("subject")])) for f in fields])
    token_map = df.select(F.inline(entries)).filter(F.col("token").isNotNull()).distinct()
    return redacted, token_map


def rehydrate(result: DataFrame, token_map: DataFrame, fields: Iterable[str], namespaces: Mapping[str, str] | None = None,
              types: Mapping[str, str] | None = None, subject: str | None = None) -> DataFrame:
    """Put the values back; a token whose map row is gone becomes null.

    Each field meets only the map rows of its namespace.  ``types`` gives the
    type of fields that were no text; ``subject`` is the column of ``redact``.
    """
    out = result
    for f in fields:
        names = token_map.filter(F.col("field") == (namespaces or {}).get(f, f)).select(
            F.col("token").alias("__token"), F.col("value").cast((types or {}).get(f, "string")).alias("__value"),
            *([] if subject is None else [F.col("subject").alias("__subject")]))
        met = F.col(f) == F.col("__token")
        if subject is not None:
            met = met & F.col(subject).eqNullSafe(F.col("__subject"))
        out = out.join(names, met, "left").withColumn(f, F.col("__value")).drop("__token", "__value", "__subject")
    return out.select(*result.columns)


def token_join(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Equality join on tokens; neither side holds the plain value."""
    return a.join(b, on)


def check_tokens(result: DataFrame, token_map: DataFrame, field: str) -> DataFrame:
    """Rows whose token is mangled (wrong form) or unknown (no map row)."""
    known = token_map.select(F.col("token").alias(field))
    lost = result.filter(F.col(field).isNotNull()).join(known, field, "left_anti")
    return lost.withColumn("finding", F.when(F.col(field).rlike(TOKEN_PATTERN), "unknown").otherwise("mangled"))


def erase_subject(token_map: DataFrame, subjects: DataFrame, key: str = "value", fields: Iterable[str] | None = None) -> DataFrame:
    """The token map without the subjects' rows; the log itself is unchanged.

    ``key="subject"`` erases by the subject that ``redact`` recorded, and leaves
    equal values of others.  ``fields`` narrows it to these namespaces.
    """
    gone = subjects.filter(F.col(key).isNotNull()).select(F.col(key).alias("__gone")).distinct()
    hit = F.col(key) == F.col("__gone")
    if fields is not None:
        hit = hit & F.col("field").isin(*fields)
    return token_map.join(gone, hit, "left_anti")


def declassify(df: DataFrame, public: Iterable[str]) -> DataFrame:
    """Declared widening to a public shape."""
    return df.select(*public)


# -- audits -----------------------------------------------------------------

def leak_audit(df: DataFrame, classified: Mapping[str, str], zone: Column, safe_zones: Iterable[str]) -> DataFrame:
    """Rows that carry a classified field unredacted outside the safe zones.

    ``classified`` maps a column to the pattern of its plain form.
    """
    outside = ~zone.isin(*safe_zones)
    hits = F.array_compact(F.array(*[
        F.when(F.col(c).rlike(pattern) & ~F.col(c).rlike(TOKEN_PATTERN), F.lit(c)) for c, pattern in classified.items()]))
    return df.filter(outside).withColumn("leaked", hits).filter(F.size("leaked") > 0)


def zone_hops(log: DataFrame, zones: Mapping[str, str]) -> DataFrame:
    """Cause/effect pairs that cross zones, counted per pair of zones.

    Effects are counted per cause first, so a cause with very many effects
    meets the join as a few rows.
    """
    lookup = F.create_map(*[F.lit(x) for pair in zones.items() for x in pair])
    effects = (log.filter(F.col("causation_id").isNotNull())
               .groupBy("causation_id", lookup[F.col("edge")].alias("to_zone")).agg(F.count(F.lit(1)).alias("n")))
    causes = log.select(F.col("id").alias("causation_id"), lookup[F.col("edge")].alias("from_zone"))
    return (effects.join(causes, "causation_id").filter(F.col("from_zone") != F.col("to_zone"))
            .groupBy("from_zone", "to_zone").agg(F.sum("n").alias("hops")))


def type_gate_audit(log: DataFrame, gated: str, proof: str, minter: str | None = None) -> DataFrame:
    """Gated rows whose cause is not a proof (minted by ``minter``, if given)."""
    good = F.col("edge") == proof
    if minter is not None:
        good = good & (F.col("node") == minter)
    proofs = log.filter(good).select(F.col("id").alias("causation_id"))
    return log.filter(F.col("edge") == gated).join(proofs, "causation_id", "left_anti")
