"""Secrets by multipart credential linking; DataFrame functions only.

Base patterns give strong spans. Weaker shapes are parts of credentials: access identifiers, secret values and endpoints. A weak part is reported only
where complementary parts stand within its scope, a stretch of the same text, which an interval join finds: places are dealt to cells as wide as a scope,
each part looks into its own cell and the two beside it, and a semi join keeps it once, so no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.shared import Steps
from creditloom.llm.spans import matches, placed, summaries

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
KINDS = ["assign", "access", "hex"]
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]

# Weak parts: what may be an identifier of an account, a secret value, and the place where they are used.
WEAK_ID = r"(?<![A-Za-z0-9+/_-])[A-Z0-9]{16,}+(?![A-Za-z0-9+/_-])"
WEAK_KEY = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}+"
ENDPOINT = r"(?<![A-Za-z0-9])[a-z][a-z0-9+-]{1,15}+://[^\x00-\x20\"'<>]++"
SCOPE = 256


def _enough(kind: Column, value: Column) -> Column:
    """Whether a match counts: base kinds by length, weak ones by a digit; capitals and digits alone make an identifier, not a key."""
    mixed = value.rlike("[A-Z]") & value.rlike("[0-9]")
    is_id = value.rlike("^[A-Z0-9]+=*$") & value.rlike("[A-Z]")
    return (
        F.when(kind == "assign", F.length(F.regexp_extract(value, ASSIGN_VALUE, 1)) >= 12).when(kind == "access", F.length(value) >= 18)
        .when(kind == "weak_id", mixed & ~value.startswith("AKIA")).when(kind == "weak_key", value.rlike("[0-9]") & ~is_id).otherwise(F.lit(True))
    )


def _near(parts: DataFrame, others: DataFrame, scope: int, reach: int | None = None) -> DataFrame:
    """The `parts` (row, start, end, ...) that have one of `others` in the same text at most `reach` characters before or after; -1 asks for an overlap.

    Parts stand in the cells they touch, others in theirs and the neighbours; within a cell the distance decides.
    """
    reach = scope if reach is None else reach
    cells = F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))
    wider = F.sequence(F.floor(F.col("start") / scope) - 1, F.floor((F.col("end") - 1) / scope) + 1)
    mine = parts.withColumn("cell", F.explode(cells))
    theirs = others.select(F.col("row").alias("row2"), F.col("start").alias("start2"), F.col("end").alias("end2"), F.explode(wider).alias("cell2"))
    meets = (F.col("row") == F.col("row2")) & (F.col("cell") == F.col("cell2")) & (F.col("start2") <= F.col("end") + reach) & (F.col("end2") >= F.col("start") - reach)
    return mine.join(theirs, meets, "left_semi").drop("cell").distinct()


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of `docs`: id, n_assign, n_access, n_hex, base_sha256 and spans; linked weak parts have the kinds linked_id, linked_key and linked_endpoint.

    A weak identifier is reported with a secret value (weak or base) in its scope, a weak secret value with an identifier (weak or base) or an endpoint, an endpoint
    with both an identifier and a secret value. An identifier has 16 or more capitals and digits, a secret value 24 or more key characters with a digit. Weak parts that overlap a base span are part of it and are not reported. Null and empty texts have no spans (the hash
    of an empty list). Repeated rows stay repeated; a null id is kept; further columns are neither read nor returned. Texts are read whole, whatever their length.
    """
    steps = Steps(docs.sparkSession, "secrets")
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    text = F.col("text")
    named = F.lit(False)
    for name in NAMES:
        named |= F.contains(F.lower("text"), F.lit(name))
    found = F.concat(
        matches("assign", text, ASSIGN, named), matches("access", text, ACCESS, F.contains("text", F.lit("AKIA"))), matches("hex", text, HEX, text.rlike("[0-9a-f]{16}")),
        matches("weak_id", text, WEAK_ID, text.rlike("[A-Z0-9]{16}")), matches("weak_key", text, WEAK_KEY, text.rlike("[A-Za-z0-9+/_-]{24}")),
        matches("endpoint", text, ENDPOINT, F.contains("text", F.lit("://"))),
    )
    held = steps.write("matches", rows.select("row", "id", found.alias("found")))
    every = placed(held.select("row", F.inline("found"))).where(_enough(F.col("kind"), F.col("value")))
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    every = steps.write("places", every.select("row", "kind", mixed.alias("mixed"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    base = every.where(F.col("kind").isin(KINDS)).drop("mixed")
    weak = every.where(~F.col("kind").isin(KINDS))
    weak = steps.write("weak", weak.join(_near(weak, base, scope, -1), ["row", "kind", "start", "end"], "left_anti"))
    # A stretch of an endpoint is no part beside it, unless it mixes capitals, small letters and digits as a key carried in it does.
    within = _near(weak.where("kind = 'weak_key' AND NOT mixed"), weak.where("kind = 'endpoint'"), scope, -1)
    weak = weak.join(within, ["row", "kind", "start", "end"], "left_anti").drop("mixed")
    ids, keys, ends = (weak.where(F.col("kind") == k) for k in ("weak_id", "weak_key", "endpoint"))
    any_id = ids.unionByName(base.where("kind = 'access'"))
    any_key = keys.unionByName(base.where("kind <> 'access'"))
    linked = _near(ids, any_key, scope).unionByName(_near(keys, any_id.unionByName(ends), scope)).unionByName(_near(_near(ends, any_id, scope), any_key, scope))
    names = F.create_map(*[F.lit(x) for x in ("weak_id", "linked_id", "weak_key", "linked_key", "endpoint", "linked_endpoint")])
    return summaries(held.select("row", "id"), base.unionByName(linked.withColumn("kind", names[F.col("kind")])), KINDS, id_column)
