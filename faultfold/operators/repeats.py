"""Contextual repeats: is a new incident one of the reports of the last hours?

An incident is compared with reports of its own severity and service created in the look-back
period. Listing all such pairs grows with the square of a busy service, so candidate sets are ranges of
running totals, and the best match is found over classes of texts (:func:`best_repeats`).
:func:`repeat_scores` does list every matching pair of contents, for those who want the list.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.text import fold_space
from faultfold.operators.answers import REPEAT_VERDICT, read_verdict
from faultfold.operators.prefix import number_rows, running
from faultfold.operators.reports import apply_deltas, follower_deltas, make_reports
from faultfold.session import settle

LOOKBACK_SECONDS = 2 * 3600
THRESHOLD = 0.6

# The fields of a report that a repeat check looks at.
CANDIDATE_FIELDS = [
    "id",
    "operational_summary",
    "root_cause",
    "service_name",
    "business_impact",
    "severity",
    "first_seen_timestamp",
    "last_seen_timestamp",
    "incident_count",
]

_GROUP = ["severity", "service_name"]
_SIDE = [*_GROUP, "bucket", "content", "words"]
_SLACK = 1e-9
# A word of no more contents than this is compared pair by pair, one of more by class; both are exact.
_RARE = 8
# Candidates that a judge is shown at a time.
BLOCK = 50


def slim_candidates(reports: DataFrame) -> DataFrame:
    """Only the compared fields, of those the reports have."""
    return reports.select(*[c for c in CANDIDATE_FIELDS if c in reports.columns])


def content_words() -> Column:
    """Sorted distinct words of summary, cause, service and impact together."""
    text = F.concat_ws(
        " ", "operational_summary", "root_cause", "service_name", "business_impact"
    )
    words = F.split(fold_space(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    return F.sort_array(F.array_distinct(F.array_remove(words, "")))


def _before(seconds: int) -> Column:
    return F.make_dt_interval(secs=F.lit(seconds))


def numbered_reports(reports: DataFrame) -> DataFrame:
    """Reports with their position by creation inside severity and service: what ranges refer to."""
    return number_rows(reports.select("id", *_GROUP, "created_at"), _GROUP, ["created_at", "id"])


def candidate_ranges(
    incidents: DataFrame, reports: DataFrame, seconds: int = LOOKBACK_SECONDS
) -> DataFrame:
    """The candidate set of each incident, as a range of positions of :func:`numbered_reports`.

    ``incidents`` need incident_id, severity, service_name and as_of. Candidates have
    as_of - period <= created_at < as_of, so they lie next to each other: the reports of the same
    severity and service from ``first_position`` to ``last_position``; both are null for an empty
    set. Reports and the two ends of every look-back go through one running total.
    """
    checked = incidents.where(F.coalesce("severity", F.lit("")) != "")
    ends = checked.select(
        *_GROUP,
        "incident_id",
        F.inline(
            F.array(
                F.struct((F.col("as_of") - _before(seconds)).alias("at"), F.lit(-1).alias("sign")),
                F.struct(F.col("as_of").alias("at"), F.lit(1).alias("sign")),
            )
        ),
    )
    nothing = F.lit(None).cast("string")
    line = ends.select(
        *_GROUP, "at", F.lit(0).alias("side"), "incident_id", "sign", nothing.alias("id")
    ).unionByName(
        reports.select(
            *_GROUP,
            F.col("created_at").alias("at"),
            F.lit(1).alias("side"),
            nothing.alias("incident_id"),
            F.lit(0).alias("sign"),
            "id",
        )
    )
    is_report = F.col("side") == 1
    counted = running(
        line.withColumn("row_id", F.concat_ws("/", "incident_id", "id", F.col("sign"))),
        _GROUP,
        ["at", "side", "row_id"],
        sums={"n": F.when(is_report, 1).otherwise(0).cast("bigint")},
        maxima={"newest": F.when(is_report, F.struct(F.col("at").alias("c"), F.col("id").alias("i")))},
    )
    spans = counted.where(~is_report).groupBy("incident_id").agg(
        F.max(F.when(F.col("sign") < 0, F.col("n"))).alias("before"),
        F.max(F.when(F.col("sign") > 0, F.col("n"))).alias("upto"),
        F.max("newest").alias("newest"),
    )
    has_any = F.col("upto") > F.col("before")
    return spans.select(
        "incident_id",
        (F.col("upto") - F.col("before")).alias("n_candidates"),
        F.when(has_any, F.col("newest.i")).alias("newest_id"),
        F.when(has_any, F.col("before") + 1).alias("first_position"),
        F.when(has_any, F.col("upto")).alias("last_position"),
    )


def repeat_candidates(
    incidents: DataFrame, reports: DataFrame, seconds: int = LOOKBACK_SECONDS
) -> DataFrame:
    """How many candidates each incident has, and the newest of them."""
    found = candidate_ranges(incidents, reports, seconds)
    return found.select("incident_id", "n_candidates", "newest_id")


def _contents(rows: DataFrame, at: str, seconds: int) -> DataFrame:
    """Rows with their words, content key and time bucket; buckets are one look-back long."""
    bucket = F.floor(F.unix_timestamp(at) / seconds).cast("bigint")
    return rows.select(
        "*", content_words().alias("words"), bucket.alias("bucket")
    ).withColumn("content", F.md5(F.concat_ws(" ", "words")))


def _rare_words(sides: DataFrame, threshold: float) -> DataFrame:
    """One row per content and word of its prefix.

    Words are put in one global order, rarest first. Two sets whose Jaccard similarity reaches the
    threshold must share a word among the first |s| - ceil(t|s|) + 1 of each, so joining on these
    words loses no match while common words join nothing.
    """
    words = sides.select("content", "words").distinct().select("content", F.explode("words").alias("word"))
    rarity = words.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    ranked = words.join(rarity, "word").groupBy("content").agg(
        F.sort_array(F.collect_list(F.struct("uses", "word"))).alias("ranked")
    )
    size = F.size("ranked")
    # The slack keeps a product such as 3.0000000000000004 from being rounded up to 4.
    keep = (size - F.ceil(size * F.lit(threshold) - F.lit(_SLACK)) + 1).cast("int")
    return ranked.select(
        "content", F.explode(F.slice("ranked", F.lit(1), keep)["word"]).alias("word")
    )


def repeat_scores(
    incidents: DataFrame,
    reports: DataFrame,
    threshold: float = THRESHOLD,
    seconds: int = LOOKBACK_SECONDS,
) -> DataFrame:
    """Per incident and matching content: the similarity and the newest candidate with it.

    Word-set Jaccard of at least ``threshold``; exact, see :func:`_rare_words`.
    """
    asked = incidents.where(F.coalesce("severity", F.lit("")) != "")
    # Both sides are read several times below.
    new = settle(_contents(asked, "as_of", seconds).select("incident_id", "as_of", *_SIDE))
    old = settle(_contents(reports, "created_at", seconds).select("id", "created_at", *_SIDE))
    asking = new.select(*_SIDE).distinct()
    # A look-back reaches into its own bucket and the one before.
    held = (
        old.select(*_SIDE)
        .withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
        .distinct()
    )
    prefix = _rare_words(asking.select("content", "words").unionByName(held.select("content", "words")), threshold)

    ask = asking.join(prefix, "content").select(
        "severity", "service_name", "bucket", "word", "content", "words"
    )
    hold = held.join(prefix, "content").select(
        F.col("severity").alias("h_severity"),
        F.col("service_name").alias("h_service"),
        F.col("bucket").alias("h_bucket"),
        F.col("word").alias("h_word"),
        F.col("content").alias("report_content"),
        F.col("words").alias("report_words"),
    )
    small = F.least(F.size("words"), F.size("report_words"))
    large = F.greatest(F.size("words"), F.size("report_words"))
    shared = F.size(F.array_intersect("words", "report_words"))
    total = F.size("words") + F.size("report_words") - shared
    pairs = (
        ask.join(
            hold,
            (F.col("severity") == F.col("h_severity"))
            & F.col("service_name").eqNullSafe(F.col("h_service"))
            & (F.col("bucket") == F.col("h_bucket"))
            & (F.col("word") == F.col("h_word")),
        )
        .where(small >= large * F.lit(threshold) - F.lit(_SLACK))
        .select(*_GROUP, "bucket", "content", "report_content", (shared / total).alias("score"))
        .where(F.col("score") >= threshold)
        .distinct()
    )
    return _newest_per_content(new, old, pairs, seconds)


def best_repeats(
    incidents: DataFrame,
    reports: DataFrame,
    threshold: float = THRESHOLD,
    seconds: int = LOOKBACK_SECONDS,
) -> DataFrame:
    """The best candidate per incident, as ``best_match(repeat_scores(...))`` has it, without the list.

    Texts of one template that differ in an id all match each other, so a list of matches grows with
    their square. Three ways together find the best one, each with few rows:

    * equal contents, by a join on the content;
    * contents that share a word of at most ``_RARE`` contents, compared pair by pair: such a word
      makes no more than ``_RARE``² pairs;
    * all others by *class*. A word that two contents do not share counts by its presence only, so
      contents with the same common words and the same size are alike; classes are compared, and the
      newest report of a class stands for it.

    A class score never exceeds that of a pair, and where it falls short of it the pair has a row of
    its own by one of the other ways. The maximum over all rows is therefore exact.
    """
    new, old, _, pairs = _matched(incidents, reports, threshold, seconds)
    # Every row goes by its content and by its class, in one pass.
    either = F.explode(F.array("content", "class"))
    return best_match(
        _newest_per_content(new.withColumn("content", either), old.withColumn("content", either), pairs, seconds)
    )


def repeat_classes(
    incidents: DataFrame,
    reports: DataFrame,
    threshold: float = THRESHOLD,
    seconds: int = LOOKBACK_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """All matching contents without a list of their pairs: (matches, members).

    ``matches`` has severity, service_name, bucket (of the incident), content, report_content and
    score, where a content is that of a row or a class of contents; a pair of classes stands for all
    pairs of their members. ``members`` has content and class of every content. Two contents that
    meet in a bucket match with the highest score of the rows for themselves or their classes, and
    with none otherwise: that is what :func:`repeat_scores` lists pair by pair.

    A template with n different ids is one class, so its matches are one row and its members n.
    """
    _, _, label, pairs = _matched(incidents, reports, threshold, seconds)
    return pairs.distinct(), label


def _matched(
    incidents: DataFrame, reports: DataFrame, threshold: float, seconds: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Incidents and reports with content and class, the class of each content, and what matches."""
    asked = incidents.where(F.coalesce("severity", F.lit("")) != "")
    # Both sides are read several times below; together they are worked out side by side.
    both = settle(
        _contents(asked, "as_of", seconds)
        .select(F.lit(True).alias("asks"), "incident_id", "as_of", *_SIDE)
        .unionByName(
            _contents(reports, "created_at", seconds).select(
                F.lit(False).alias("asks"), "id", "created_at", *_SIDE
            ),
            allowMissingColumns=True,
        )
    )
    raw_new = both.where("asks").drop("asks", "id", "created_at")
    raw_old = both.where("NOT asks").drop("asks", "incident_id", "as_of")
    classed = settle(_classes(both.select("content", "words"), threshold))
    label = classed.select("content", "class")
    new = raw_new.drop("words").join(label, "content")
    old = raw_old.drop("words").join(label, "content")

    place = [*_GROUP, "bucket"]
    held = old.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    asks, holds = new.select(*place, "content").distinct(), held.select(*place, "content").distinct()
    same = _meet(asks, holds, place, "content", "content").withColumn("score", F.lit(1.0))

    rare = classed.select("content", F.explode("rare").alias("word"))
    near = _meet(asks.join(rare, "content"), holds.join(rare, "content"), [*place, "word"], "content", "content")
    words = classed.select("content", "words")
    near = _scored(near.drop("word").distinct(), words, "content", threshold)

    common = classed.select("class", "core", "size", "prefix").dropDuplicates(["class"])
    lead = common.select("class", F.explode("prefix").alias("word"))
    ask_classes = new.select(*place, "class").distinct().join(lead, "class")
    hold_classes = held.select(*place, "class").distinct().join(lead, "class")
    alike = _meet(ask_classes, hold_classes, [*place, "word"], "class", "class")
    alike = _scored(alike.drop("word").distinct(), common.select("class", "core", "size"), "class", threshold)

    columns = [*place, "content", "report_content", "score"]
    pairs = (
        same.select(*columns)
        .unionByName(near.select(*columns))
        .unionByName(
            alike.select(
                *place, F.col("class").alias("content"), F.col("report_class").alias("report_content"), "score"
            )
        )
    )
    return new, old, label, pairs


def _classes(sides: DataFrame, threshold: float) -> DataFrame:
    """Per content: words, size, its rare words that a match may start with, the common ones (core),
    the core words that a match may start with, and the class."""
    once = sides.dropDuplicates(["content"])
    words = once.select("content", F.explode("words").alias("word"))
    uses = words.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    ranked = words.join(uses, "word").groupBy("content").agg(
        F.sort_array(F.collect_list(F.struct("uses", "word"))).alias("ranked")
    )
    size = F.size("ranked")
    keep = (size - F.ceil(size * F.lit(threshold) - F.lit(_SLACK)) + 1).cast("int")
    lead = F.slice("ranked", F.lit(1), keep)
    parted = ranked.select(
        "content",
        size.alias("size"),
        F.filter(lead, lambda w: w["uses"] <= _RARE)["word"].alias("rare"),
        F.filter(lead, lambda w: w["uses"] > _RARE)["word"].alias("prefix"),
        F.sort_array(F.filter("ranked", lambda w: w["uses"] > _RARE)["word"]).alias("core"),
        F.sort_array("ranked.word").alias("words"),
    )
    name = F.md5(F.concat_ws(" ", F.col("size").cast("string"), "core"))
    # A content without a word matches nothing but its equal.
    empty = once.where(F.size("words") == 0).select(
        "content", F.lit(0).alias("size"), *[F.array().cast("array<string>").alias(c)
                                             for c in ("rare", "prefix", "core", "words")]
    )
    return parted.unionByName(empty).withColumn("class", F.concat(F.lit("class "), name))


def _meet(asks: DataFrame, holds: DataFrame, on: list[str], ask: str, hold: str) -> DataFrame:
    """Inner join, null-safe, of asking and held contents (or classes)."""
    right = holds.select(*[F.col(c).alias(f"_h_{c}") for c in on if c != hold], F.col(hold).alias(f"report_{hold}"))
    match = F.lit(True)
    for c in on:
        if c != hold:
            match = match & (
                F.col(c).eqNullSafe(F.col(f"_h_{c}")) if c == "service_name" else F.col(c) == F.col(f"_h_{c}")
            )
    if ask == hold and "word" not in on:
        match = match & (F.col(ask) == F.col(f"report_{hold}"))
    return asks.join(right, match).select(*on, ask, f"report_{hold}")


def _scored(pairs: DataFrame, sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """Jaccard of pairs of keys by their sets: ``words`` in full, or ``core`` beside the full ``size``."""
    column = "words" if "words" in sets.columns else "core"
    size = F.size("words") if column == "words" else F.col("size")
    left = sets.select(F.col(key), F.col(column).alias("_a"), size.alias("_na"))
    right = sets.select(F.col(key).alias(f"report_{key}"), F.col(column).alias("_b"), size.alias("_nb"))
    shared = F.size(F.array_intersect("_a", "_b"))
    score = shared / (F.col("_na") + F.col("_nb") - shared)
    joined = pairs.join(left, key).join(right, f"report_{key}")
    return joined.withColumn("score", score).where(F.col("score") >= threshold).drop("_a", "_b", "_na", "_nb")


def _newest_per_content(new: DataFrame, old: DataFrame, pairs: DataFrame, seconds: int) -> DataFrame:
    """Attach to every (incident, matching content) the newest report of that content in time."""
    p = pairs.select(
        F.col("severity").alias("p_severity"),
        F.col("service_name").alias("p_service"),
        F.col("bucket").alias("p_bucket"),
        F.col("content").alias("p_content"),
        "report_content",
        "score",
    )
    wanted = new.join(
        p,
        (F.col("severity") == F.col("p_severity"))
        & F.col("service_name").eqNullSafe(F.col("p_service"))
        & (F.col("bucket") == F.col("p_bucket"))
        & (F.col("content") == F.col("p_content")),
    ).select(*_GROUP, "report_content", "incident_id", "score", "as_of")
    key = [*_GROUP, "report_content"]
    nothing = F.lit(None).cast("string")
    line = wanted.select(
        *key, F.col("as_of").alias("at"), F.lit(0).alias("side"), "incident_id", "score", nothing.alias("id")
    ).unionByName(
        old.select(
            *_GROUP,
            F.col("content").alias("report_content"),
            F.col("created_at").alias("at"),
            F.lit(1).alias("side"),
            nothing.alias("incident_id"),
            F.lit(None).cast("double").alias("score"),
            "id",
        )
    )
    newest = F.when(
        F.col("side") == 1, F.struct(F.col("at").alias("created_at"), F.col("id").alias("id"))
    )
    found = running(
        line.withColumn("row_id", F.concat_ws("/", "incident_id", "id")),
        key,
        ["at", "side", "row_id"],
        maxima={"newest": newest},
    )
    in_time = F.col("newest.created_at") >= F.col("at") - _before(seconds)
    return found.where((F.col("side") == 0) & in_time).select(
        "incident_id",
        "report_content",
        F.col("newest.id").alias("report_id"),
        F.col("newest.created_at").alias("report_created_at"),
        "score",
    )


def best_match(scores: DataFrame) -> DataFrame:
    """The one best candidate per incident: highest score, then newest, then greatest id."""
    top = F.max(F.struct("score", "report_created_at", "report_id"))
    return scores.groupBy("incident_id").agg(top.alias("b")).select(
        "incident_id", "b.report_id", "b.score", "b.report_created_at"
    )


def valid_matches(
    matches: DataFrame, incidents: DataFrame, reports: DataFrame, seconds: int = LOOKBACK_SECONDS
) -> DataFrame:
    """Matches, from whatever scorer, whose report really is a candidate of the incident."""
    i = incidents.select("incident_id", "severity", "service_name", "as_of")
    r = reports.select(
        F.col("id").alias("report_id"),
        F.col("severity").alias("r_severity"),
        F.col("service_name").alias("r_service"),
        F.col("created_at").alias("r_created"),
    )
    candidate = (
        (F.col("severity") == F.col("r_severity"))
        & F.col("service_name").eqNullSafe(F.col("r_service"))
        & (F.col("r_created") >= F.col("as_of") - _before(seconds))
        & (F.col("r_created") < F.col("as_of"))
    )
    return matches.join(i, "incident_id").join(r, "report_id").where(candidate).select(*matches.columns)


def judged_repeats(
    incidents: DataFrame,
    reports: DataFrame,
    judge: Callable[[dict, list[dict]], dict],
    seconds: int = LOOKBACK_SECONDS,
    block: int = BLOCK,
) -> DataFrame:
    """Verdicts of ``judge(incident, candidates)``, a model perhaps, on all candidates of every incident.

    No word filter comes before: candidates are the whole look-back, handed over in blocks of at most
    ``block`` neighbours by position. The judge answers with is_repetitive, matching_report_id and
    reason, each of its type; an id that is not among the block's candidates is no match. Of several blocks with a match
    the newest report counts, then the greatest id. A failed call becomes data: ``error`` holds the
    failure of some block, and the other blocks still count.

    Columns: incident_id, report_id and report_created_at (null without a match), score (1.0 for a
    match), reason, error. Incidents without candidates have no row. Rows with a report_id go into
    :func:`repeat_decisions`.
    """
    fields = ["operational_summary", "root_cause", "service_name", "business_impact"]
    new = incidents.select("incident_id", *_GROUP, F.to_json(F.struct(*fields)).alias("_new"))
    number = lambda c: F.floor((F.col(c) - 1) / block).cast("bigint")
    spans = candidate_ranges(incidents, reports, seconds).where("n_candidates > 0")
    asks = new.join(spans, "incident_id").withColumn(
        "_block", F.explode(F.sequence(number("first_position"), number("last_position")))
    )
    slim = slim_candidates(reports)
    texts = slim.select("id", F.to_json(F.struct(*slim.columns)).alias("json"))
    held = numbered_reports(reports).join(texts, "id").withColumn("_block", number("position"))
    held = held.groupBy(*[F.col(c).alias(f"_{c}") for c in _GROUP], F.col("_block").alias("_held")).agg(
        F.sort_array(F.collect_list(F.struct("position", "id", "json"))).alias("_old")
    )
    same = (F.col("_block") == F.col("_held")) & F.col("severity").eqNullSafe(F.col("_severity"))
    pairs = asks.join(held, same & F.col("service_name").eqNullSafe(F.col("_service_name")))
    inside = F.filter("_old", lambda c: c["position"].between(F.col("first_position"), F.col("last_position")))
    pairs = pairs.select("incident_id", "_new", inside.alias("_old"))
    pairs = pairs.select("incident_id", "_new", F.col("_old.json").alias("_json"), F.col("_old.id").alias("_ids"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, reasons, errors = [], [], []
            for new_, old, ids in zip(batch["_new"], batch["_json"], batch["_ids"], strict=True):
                match = reason = error = None
                try:
                    answer = judge(json.loads(new_), [json.loads(x) for x in old])
                    answer = read_verdict(answer, REPEAT_VERDICT)
                    reason = answer["reason"]
                    if answer["is_repetitive"] and answer["matching_report_id"] in list(ids):
                        match = answer["matching_report_id"]
                except Exception as failure:
                    reason, error = None, f"{type(failure).__name__}: {failure}"
                found.append(match)
                reasons.append(reason)
                errors.append(error)
            yield batch[["incident_id"]].assign(
                report_id=pd.Series(found, index=batch.index, dtype="object"),
                reason=pd.Series(reasons, index=batch.index, dtype="object"),
                error=pd.Series(errors, index=batch.index, dtype="object"),
            )

    kinds = dict(incidents.dtypes)["incident_id"], dict(reports.dtypes)["id"]
    schema = f"incident_id {kinds[0]}, report_id {kinds[1]}, reason string, error string"
    # Settled, so that no later action asks the model again.
    answers = settle(pairs.select("incident_id", "_new", "_json", "_ids").mapInPandas(ask, schema))
    times = reports.select(F.col("id").alias("report_id"), F.col("created_at").alias("report_created_at"))
    answers = answers.join(times, "report_id", "left")
    rank = F.struct(F.col("report_id").isNotNull(), "report_created_at", "report_id", "reason").alias("r")
    top = answers.groupBy("incident_id").agg(F.max(rank).alias("t"), F.max("error").alias("error"))
    return top.select(
        "incident_id",
        F.col("t.report_id").alias("report_id"),
        F.col("t.report_created_at").alias("report_created_at"),
        F.when(F.col("t.report_id").isNotNull(), F.lit(1.0)).alias("score"),
        F.col("t.reason").alias("reason"),
        "error",
    )


def repeat_decisions(incidents: DataFrame, best: DataFrame) -> DataFrame:
    """increment an existing report, or insert a new one.

    An incident without a severity has no candidates and is always inserted.
    """
    matched = incidents.select("incident_id", "severity").join(
        best.select("incident_id", "report_id", "score"), "incident_id", "left"
    )
    repeat = F.col("report_id").isNotNull() & (F.coalesce("severity", F.lit("")) != "")
    reason = (
        F.when(F.coalesce("severity", F.lit("")) == "", "no severity")
        .when(repeat, F.format_string("similarity %.3f", "score"))
        .otherwise("no similar report")
    )
    return matched.select(
        "incident_id",
        F.when(repeat, "increment").otherwise("insert").alias("action"),
        F.when(repeat, F.col("report_id")).alias("report_id"),
        reason.alias("reason"),
    )


def repeat_deltas(incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """What repeats add to reports: one occurrence per incident, the last sighting and insert id.

    ``incidents`` need incident_id, last_seen and last_insert_id.
    """
    repeats = decisions.where(F.col("action") == "increment").select("incident_id", "report_id")
    followers = repeats.join(incidents, "incident_id").select(
        "report_id", F.col("last_seen").alias("ts"), F.col("last_insert_id").alias("insert_id")
    )
    return follower_deltas(followers)


def apply_repeats(reports: DataFrame, incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reports after the decisions: repeats counted, all other incidents as new reports.

    An incident whose report exists already, as after a replay, is not inserted again.
    """
    inserts = decisions.where(F.col("action") == "insert").select("incident_id")
    made = make_reports(incidents.join(inserts, "incident_id", "left_semi"))
    fresh = made.join(reports.select("id"), "id", "left_anti")
    counted = apply_deltas(reports, repeat_deltas(incidents, decisions))
    return counted.unionByName(fresh.select(*reports.columns))
