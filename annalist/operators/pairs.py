"""Which records are worth comparing, and what a comparison decides.

Two records of one company are candidates if they share an entity (within a date
window, or with an unknown date) or share a domain within a few days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annalist.functions import text as tx
from annalist.functions.dates import FAR_DAYS, iso_date

# Windows, the cap on candidates per record, decision scores.
EVENT_WINDOW = 30
CANONICAL_WINDOW = 180
DOMAIN_WINDOW = 3
MAX_CANDIDATES = 10
AUTO_SAME_EVENT = 0.85
AUTO_RELATED = 0.75


@dataclass(frozen=True)
class RuleClassifier:
    """Rule form of the pair decision; scores are parameters.

    ``columns`` decides inside a plan, ``decide`` inside a task; a caller's model
    replaces both by subclassing.
    """

    same_event: float = 0.9
    related: float = 0.7
    unrelated: float = 0.6

    WHY = {
        "same_event": "same entity and same event type",
        "related_distinct": "shared entity or domain, different event type",
        "unrelated": "no shared entity or domain",
    }

    @property
    def same_within(self) -> tuple[str, ...]:
        """Columns that two events called the same always share, filled; a caller's model declares its own."""
        return ("entity", "event_type") if type(self) is RuleClassifier else ()

    def columns(self, a, b) -> Column:
        """struct<relationship_type, confidence, rationale> of two records (row-like columns)."""
        entity = F.coalesce((F.length(a["entity"]) > 0) & (a["entity"] == b["entity"]), F.lit(False))
        domain = F.coalesce((F.length(a["domain"]) > 0) & (a["domain"] == b["domain"]), F.lit(False))
        same = entity & a["event_type"].eqNullSafe(b["event_type"])

        def out(kind: str, score: float) -> Column:
            return F.struct(
                F.lit(kind).alias("relationship_type"),
                F.lit(float(score)).alias("confidence"),
                F.lit(self.WHY[kind]).alias("rationale"),
            )

        return (
            F.when(same, out("same_event", self.same_event))
            .when(entity | domain, out("related_distinct", self.related))
            .otherwise(out("unrelated", self.unrelated))
        )

    def decide(self, a: dict, b: dict) -> tuple[str, float]:
        entity = bool(a["entity"]) and a["entity"] == b["entity"]
        domain = bool(a["domain"]) and a["domain"] == b["domain"]
        if entity and a["event_type"] == b["event_type"]:
            return "same_event", self.same_event
        if entity or domain:
            return "related_distinct", self.related
        return "unrelated", self.unrelated


def both_forms(rule: RuleClassifier) -> RuleClassifier:
    """The rule, if it gives both forms or neither: one alone would decide differently inside a plan and inside a task."""
    own = [getattr(type(rule), form) is not getattr(RuleClassifier, form) for form in ("columns", "decide")]
    if own[0] != own[1]:
        raise ValueError(f"{type(rule).__name__} must give both columns() and decide()")
    return rule


def auto_applies(kind: Column, confidence: Column) -> Column:
    """Whether a decision is strong enough to act on without review."""
    return (
        F.when(kind == "same_event", confidence >= AUTO_SAME_EVENT)
        .when(kind == "related_distinct", confidence >= AUTO_RELATED)
        .otherwise(F.lit(False))
    )


def auto_apply_value(kind: str, confidence: float) -> bool:
    floor = {"same_event": AUTO_SAME_EVENT, "related_distinct": AUTO_RELATED}.get(kind)
    return floor is not None and confidence >= floor


def keyed(
    df: DataFrame,
    id: str = "event_id",
    company: str = "company_id",
    date: str = "event_date",
    entity: str = "entity",
    domain: str = "domain",
) -> DataFrame:
    """Add blocking columns _id, _company, _d (day number, FAR_DAYS if unknown), _entity, _domain."""
    return df.withColumns(
        {
            "_id": F.col(id),
            "_company": F.col(company),
            "_d": F.coalesce(F.unix_date(iso_date(F.col(date))), F.lit(FAR_DAYS)),
            "_entity": tx.key(F.col(entity)),
            "_domain": tx.key(F.col(domain)),
        }
    )


def _both_ways(left: DataFrame, right: DataFrame, on: list[str], carry: list[str], residual: Column) -> DataFrame:
    """Join two prepared sides and name the lower id ``a``."""
    joined = left.alias("x").join(right.alias("y"), on).where(residual)
    swap = F.col("x._id") > F.col("y._id")
    cols = []
    for c in ["_id", *carry]:
        cols.append(F.when(swap, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(f"a{c}" if c == "_id" else f"a_{c}"))
        cols.append(F.when(swap, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(f"b{c}" if c == "_id" else f"b_{c}"))
    unknown = (F.col("x._d") == FAR_DAYS) | (F.col("y._d") == FAR_DAYS)
    gap = F.when(~unknown, F.abs(F.col("x._d") - F.col("y._d")))
    return joined.select(*cols, gap.alias("days"))


def candidate_pairs(
    df: DataFrame,
    window_days: int = EVENT_WINDOW,
    id: str = "event_id",
    company: str = "company_id",
    date: str = "event_date",
    entity: str = "entity",
    domain: str = "domain",
    carry: list[str] | None = None,
) -> DataFrame:
    """Every candidate pair once: a_id < b_id, days between (NULL if unknown), carried columns.

    An OR of two equalities is no hash join, so this is three disjoint equi-joins:
    same entity with both dates (by date bucket), same entity with a date missing,
    and same domain but not same entity (by date bucket). The result can be
    quadratic in a hot key by definition; operators that only need the closest
    partners use ``nearest_candidates``, which never forms the pairs.
    """
    kept = carry or []
    base = keyed(df, id, company, date, entity, domain).select("_id", "_company", "_d", "_entity", "_domain", *kept)
    dated = base.where(F.col("_d") < FAR_DAYS)

    def bucketed(key: str, width: int) -> tuple[DataFrame, DataFrame]:
        rows = dated.where(F.col(key).isNotNull())
        slot = F.floor(F.col("_d") / F.lit(width + 1))
        near = F.explode(F.array(slot - 1, slot, slot + 1))
        return rows.withColumn("_slot", slot), rows.withColumn("_slot", near)

    ordered = F.col("x._id") < F.col("y._id")
    gap = F.abs(F.col("x._d") - F.col("y._d"))
    same_entity = F.col("x._entity").eqNullSafe(F.col("y._entity")) & F.col("x._entity").isNotNull()

    left, right = bucketed("_entity", window_days)
    by_entity = _both_ways(left, right, ["_company", "_entity", "_slot"], kept, ordered & (gap <= window_days))

    blank = base.where((F.col("_d") == FAR_DAYS) & F.col("_entity").isNotNull())
    named = base.where(F.col("_entity").isNotNull())
    by_blank = _both_ways(blank, named, ["_company", "_entity"], kept, (F.col("y._d") < FAR_DAYS) | ordered)

    near_days = min(window_days, DOMAIN_WINDOW)
    left, right = bucketed("_domain", near_days)
    by_domain = _both_ways(
        left, right, ["_company", "_domain", "_slot"], kept, ordered & (gap <= near_days) & ~same_entity
    )
    return by_entity.unionByName(by_blank).unionByName(by_domain)


def classify_pairs(pairs: DataFrame, classifier: RuleClassifier | None = None) -> DataFrame:
    """Decide pairs that carry event_type, entity and domain of both sides; adds auto_apply."""
    rule = classifier or RuleClassifier()
    side = lambda p: {c: F.col(f"{p}_{c}") for c in ("event_type", "entity", "domain")}
    decided = pairs.withColumn("_r", rule.columns(side("a"), side("b")))
    return decided.select(
        *[c for c in pairs.columns if c not in ("relationship_type", "confidence", "rationale")],
        "_r.relationship_type",
        "_r.confidence",
        "_r.rationale",
    ).withColumn("auto_apply", auto_applies(F.col("relationship_type"), F.col("confidence")))


FACTS = ("event_type", "entity", "domain")


def _key_lists(items: DataFrame, pool: DataFrame, key: str, window: int, reach: int, k: int, blanks: bool) -> DataFrame:
    """Per (company, key value, day of an item): the nearest pool rows, at most 2k+1.

    Ranking is limited to k+1 rows per day before anything is collected, so a hot
    key never gathers more than days x (k+1) small rows, whatever its size. At most
    k+1 of the rows of one day can matter (one may be the item itself), and at most
    ``reach`` other days on either side.
    """
    keys = ["_company", key]
    lowest = W.partitionBy(*keys, "_d").orderBy("_id")
    few = pool.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(lowest)).where(F.col("_n") <= k + 1)
    entry = F.struct(F.col("_d").alias("d"), F.col("_id").alias("id"), *[F.col(c) for c in FACTS])
    per_day = few.groupBy(*keys, "_d").agg(F.array_sort(F.collect_list(entry)).alias("_here"))
    if items is not pool:
        asked = items.where(F.col(key).isNotNull()).select(*keys, "_d").distinct()
        per_day = per_day.join(asked, [*keys, "_d"], "full")

    # days without pool rows must not use up the reach, so only days with rows are counted
    in_order = W.partitionBy(*keys).orderBy("_d")
    numbered = per_day.withColumn("_no", F.sum(F.when(F.col("_here").isNotNull(), 1).otherwise(0)).over(in_order))
    whole = W.partitionBy(*keys)
    around = W.partitionBy(*keys).orderBy("_no").rangeBetween(-reach, reach)
    day = F.col("_d")

    def ranked(entries: Column) -> Column:
        return F.transform(
            entries,
            lambda x: F.struct(
                F.when((x["d"] == FAR_DAYS) | (day == FAR_DAYS), F.lit(FAR_DAYS))
                .otherwise(F.abs(x["d"] - day))
                .alias("gap"),
                x["d"],
                x["id"],
                *[x[c] for c in FACTS],
            ),
        )

    spread = numbered.withColumn("_around", F.flatten(F.collect_list("_here").over(around)))
    if blanks:
        spread = spread.withColumns(
            {
                "_undated": F.flatten(F.collect_list(F.when(day == FAR_DAYS, F.col("_here"))).over(whole)),
                "_first": F.flatten(F.collect_list(F.when(F.col("_no") <= k + 1, F.col("_here"))).over(whole)),
            }
        )
    dated = F.filter(ranked(F.col("_around")), lambda x: (x["gap"] <= window) & (x["d"] < FAR_DAYS))
    if blanks:
        found = F.when(day == FAR_DAYS, ranked(F.col("_first"))).otherwise(F.concat(dated, ranked(F.col("_undated"))))
    else:
        found = F.when(day < FAR_DAYS, dated)
    return spread.select(*keys, "_d", found.alias("_found"))


def nearest_candidates(
    items: DataFrame,
    pool: DataFrame,
    window_days: int = EVENT_WINDOW,
    k: int = MAX_CANDIDATES,
    earlier_only: bool = False,
) -> DataFrame:
    """Add ``near``: the k nearest candidates in ``pool`` for each row of ``items``.

    Both frames come from ``keyed`` and hold event_type, entity and domain; pass the
    same frame twice to compare a set with itself. Candidates are ordered by day gap
    (unknown last), then date, then id; with ``earlier_only`` they precede the row in
    (date, id) order. Neither pairs nor whole groups are formed: every row joins one
    bounded list per key.
    """
    near_days = min(window_days, DOMAIN_WINDOW)
    by_entity = _key_lists(items, pool, "_entity", window_days, k, k, True)
    by_domain = _key_lists(items, pool, "_domain", near_days, near_days, k, False)

    if earlier_only:
        ok = lambda x: (x["d"] < F.col("_d")) | ((x["d"] == F.col("_d")) & (x["id"] < F.col("_id")))
    else:
        ok = lambda x: x["id"] != F.col("_id")

    with_entity = items.join(by_entity.withColumnRenamed("_found", "_e"), ["_company", "_entity", "_d"], "left")
    with_both = with_entity.join(by_domain.withColumnRenamed("_found", "_m"), ["_company", "_domain", "_d"], "left")
    kind = with_both.schema["_e"].dataType
    none = F.array().cast(kind)
    merged = F.array_distinct(F.concat(F.coalesce("_e", none), F.coalesce(F.col("_m").cast(kind), none)))
    near = F.slice(F.array_sort(F.filter(merged, ok)), 1, k)
    return with_both.withColumn("near", near).drop("_e", "_m")


def top_candidates(df: DataFrame, window_days: int = EVENT_WINDOW, k: int = MAX_CANDIDATES, **names: str) -> DataFrame:
    """Rows (item_id, rank, candidate_id, days): the k nearest candidates of every record."""
    base = keyed(df, **names).select("_id", "_company", "_d", "_entity", "_domain", *FACTS)
    near = nearest_candidates(base, base, window_days, k)
    rows = near.select(F.col("_id").alias("item_id"), "near")
    return tx.numbered(rows, ["item_id"], F.col("near"), "pos", "c").select(
        "item_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("c.id").alias("candidate_id"),
        F.when(F.col("c.gap") < FAR_DAYS, F.col("c.gap")).alias("days"),
    )
