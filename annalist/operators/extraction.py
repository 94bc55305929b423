"""Rule-based extraction of events and job tasks from text.

Every rule has a slot: pass a function of the same shape (columns in, column out,
for instance around a pandas UDF) to use a model instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from annalist.functions import text as tx

# Word, event type, action; the first word found decides.
FAMILIES: list[tuple[str, str, str]] = [
    ("announce", "strategy_announcement", "announce"),
    ("unveil", "strategy_announcement", "announce"),
    ("reveal", "strategy_announcement", "announce"),
    ("plan to", "strategy_announcement", "announce"),
    ("develop", "product_development", "build"),
    ("invest", "product_development", "build"),
    ("pilot", "pilot_program", "pilot"),
    ("trial", "pilot_program", "pilot"),
    ("test with", "pilot_program", "pilot"),
    ("launch", "product_launch", "launch"),
    ("release", "product_launch", "launch"),
    ("roll out", "product_launch", "launch"),
    ("open to the public", "product_launch", "launch"),
    ("expand", "expansion", "scale"),
    ("scale", "expansion", "scale"),
    ("partner", "partnership", "announce"),
]
# Capitalised words that begin sentences and are no names.
ENTITY_STOPWORDS = (
    "the", "as", "we", "this", "it", "they", "our", "for", "with",
    "following", "part", "background", "rollout", "conclusion",
)
# What a quoted phrase and a capitalised run look like, and the shortest task.
QUOTED = "[\"'“]([^\"'”]{2,40})[\"'”]"
CAPITALISED = r"\b([A-Z][a-zA-Z0-9]+(?:\s[A-Z0-9][a-zA-Z0-9]*){0,2})\b"
COMPLETED_ACTIONS = ("launch",)
MIN_TASK = 6


def guess_entity(
    sentence: Column, stopwords: Sequence[str] = ENTITY_STOPWORDS, excluded: Sequence[str] = ()
) -> Column:
    """First quoted phrase, else the first capitalised run that is neither stop word nor excluded."""
    quoted = F.regexp_extract(sentence, QUOTED, 1)
    runs = F.regexp_extract_all(sentence, F.lit(f"(?U){CAPITALISED}"), 1)

    def is_name(run: Column) -> Column:
        known = ~F.lower(run).isin(list(stopwords))
        return known & ~run.isin(list(excluded)) if excluded else known

    return F.coalesce(tx.filled(quoted), F.get(F.filter(runs, is_name), F.lit(0)))


def keyword_events(
    chunks: DataFrame,
    families: Sequence[tuple[str, str, str]] = FAMILIES,
    text: str = "text",
    company: str = "company",
    date: str = "published_date",
    keep: Sequence[str] = (),
    stopwords: Sequence[str] = ENTITY_STOPWORDS,
    excluded: Sequence[str] = (),
    entity: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One event per sentence that holds a family word, with the sentence as its quote."""
    table = F.array(
        *[
            F.struct(F.lit(w).alias("word"), F.lit(t).alias("event_type"), F.lit(a).alias("action"))
            for w, t, a in families
        ]
    )
    rows = tx.numbered(chunks, [*keep, company, date], tx.sentences(F.col(text)), "sentence_no", "raw_quote")
    lowered = F.lower("raw_quote")
    any_word = F.lit(False)
    for word, _, _ in families:
        any_word = any_word | F.contains(lowered, F.lit(word))
    hits = rows.where(any_word).withColumn(
        "_f", F.get(F.filter(table, lambda f: F.contains(F.lower(F.col("raw_quote")), f["word"])), F.lit(0))
    )
    named = entity(F.col("raw_quote")) if entity else guess_entity(F.col("raw_quote"), stopwords, excluded)
    dated = F.coalesce(F.col(date), F.lit("")) != ""
    return hits.select(
        *keep,
        "sentence_no",
        F.col("_f.event_type").alias("event_type"),
        F.col(company).alias("subject"),
        F.col("_f.action").alias("action"),
        F.col(date).alias("event_date"),
        F.when(dated, "day").otherwise("unknown").alias("date_precision"),
        F.when(F.col("_f.action").isin(list(COMPLETED_ACTIONS)), "completed").otherwise("planned").alias("lifecycle_status"),
        F.lit(None).cast("string").alias("domain"),
        named.alias("entity"),
        "raw_quote",
    )


def extract_pending(chunks: DataFrame, events: DataFrame, documents: DataFrame, companies: DataFrame, **options) -> DataFrame:
    """Events of the chunks that have none yet, with their documents' date and company name."""
    pending = chunks.join(events.select("chunk_id").distinct(), "chunk_id", "left_anti")
    facts = documents.select("doc_id", "company_id", "published_date").join(
        companies.select("company_id", F.col("name").alias("company")), "company_id"
    )
    return keyword_events(
        pending.join(facts, "doc_id"), keep=["chunk_id", "doc_id", "company_id"], **options
    )


def ordered_distinct(values: Column) -> Column:
    """Trimmed values without blanks; later spellings that differ only in case are dropped."""
    clean = F.filter(F.transform(values, tx.ustrip), lambda v: F.coalesce(F.length(v) > 0, F.lit(False)))
    keyed = F.transform(clean, lambda v, i: F.struct(F.lower(v).alias("key"), i.alias("at"), v.alias("v")))
    # sorted by key, the first of each run of equal keys is the first spelling
    firsts = F.transform(
        F.array(F.array_sort(keyed)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"])),
    )[0]
    in_order = F.array_sort(F.transform(firsts, lambda x: F.struct(x["at"].alias("at"), x["v"].alias("v"))))
    return F.transform(in_order, lambda x: x["v"])


def job_tasks(raw_text: Column, min_task: int = MIN_TASK) -> Column:
    """Sentences of a job description long enough to be tasks."""
    return F.filter(tx.sentences(raw_text), lambda s: F.length(s) >= min_task)


def parse_jobs(
    jobs: DataFrame, text: str = "raw_text", parser: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Add role, role_subtype, domain, tasks and entities (with skills merged in).

    ``parser`` gives struct<role, role_subtype, domain, tasks, entities, skills>.
    """
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    rule = lambda c: F.struct(
        none.alias("role"),
        none.alias("role_subtype"),
        none.alias("domain"),
        job_tasks(c).alias("tasks"),
        empty.alias("entities"),
        empty.alias("skills"),
    )
    parsed = jobs.withColumn("_p", (parser or rule)(F.col(text)))
    tasks = F.filter("_p.tasks", lambda t: F.coalesce(F.length(tx.ustrip(t)) > 0, F.lit(False)))
    both = F.concat(F.coalesce("_p.entities", empty), F.coalesce("_p.skills", empty))
    return parsed.select(
        *jobs.columns, "_p.role", "_p.role_subtype", "_p.domain", ordered_distinct(both).alias("entities"), tasks.alias("tasks")
    )


def generated_title(entity: Column, domain: Column, event_type: Column, action: Column) -> Column:
    """``label: action`` with the first known of entity, domain, event type."""
    label = F.coalesce(tx.filled(entity), tx.filled(domain), tx.filled(event_type), F.lit("Event"))
    differs = F.coalesce((F.length(action) > 0) & (action != label), F.lit(False))
    return F.when(differs, F.concat(label, F.lit(": "), action)).otherwise(label)


# What a title in the target language looks like, and leftovers of the other.
HANGUL = "[가-힣]"
LATIN_ACTION = r"(?U):\s*[A-Za-z]"
LATIN_THREAD = r"(?Ud)\b(Expansion|Initiative)\s*$"


def has_hangul(title: Column) -> Column:
    return title.rlike(HANGUL)


def needs_rewriting(title: Column) -> Column:
    return ~has_hangul(title) | title.rlike(LATIN_ACTION) | title.rlike(LATIN_THREAD)


def rewrite_titles(table: DataFrame, new_title: Column | None = None) -> DataFrame:
    """Replace titles that need it; adds ``rewritten``. Running it again changes nothing more
    once the new titles are in the target language."""
    action = F.col("action") if "action" in table.columns else F.lit(None).cast("string")
    kind = F.col("event_type") if "event_type" in table.columns else F.lit(None).cast("string")
    fresh = new_title if new_title is not None else generated_title(F.col("entity"), F.col("domain"), kind, action)
    marked = table.withColumn("rewritten", needs_rewriting(F.col("title")))
    return marked.withColumn("title", F.when(F.col("rewritten"), fresh).otherwise(F.col("title")))
