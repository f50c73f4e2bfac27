"""Lookup, aggregate, order, set and store queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions import values as V
from granary.operators import index, store, where
from granary.operators import sequences as S
from granary.operators.retrieval import small, top
from granary.plans.tables import _once, _stage
from granary.sources.tables import read_table


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "question_bank_candidate")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "chunks", "rag_input_id")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "question_bank_candidate_evidence")


def _validations(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "question_bank_candidate_validation")


def _band(name: str):
    return F.when(F.col(name) == "high", 0).when(F.col(name) == "medium", 1).otherwise(2)


def built_conditions(spark: SparkSession, d: str) -> DataFrame:
    """A query from plain values: a list, a negation, a part, a range, one of two."""
    found = where.selected(
        _candidates(spark, d), fields="id,subject,answer", order_by="id", page=2, size=30, like="stem", between="answer", any_of="period,difficulty",
        source_stage=["initial_pass", "revised_pass"], _status="rejected", stem="다", answer=[2, 4], period="1교시", difficulty="상", unknown=3,
    )
    return found


def built_groups(spark: SparkSession, d: str) -> DataFrame:
    return where.selected(_candidates(spark, d), group="subject,period", status=["expert_passed", "pending_expert_review"]).select("subject", "period", "n")


def built_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that hold, and groups of them."""
    rows = _candidates(spark, d)
    plain = where.counted(rows, status="rejected").withColumn("kind", F.lit("rows"))
    return plain.unionByName(where.counted(rows, group="subject,area", status="rejected").withColumn("kind", F.lit("groups")))


def admin_list(spark: SparkSession, d: str) -> DataFrame:
    """Four equalities and a keyword over five columns, newest first, one page."""
    rows = _candidates(spark, d).filter((F.col("status") != "rejected") & (F.col("subject") == "영상검사학") & (F.col("period") == "2교시") & (F.col("source_stage") == "initial_pass"))
    hit = None
    for c in ("stem", "explanation", "area", "detail", "id"):
        own = F.coalesce(F.col(c), F.lit("")).like("%초음파%")
        hit = own if hit is None else hit | own
    return store.page_of(rows.filter(hit), [F.desc_nulls_last("updated"), F.desc_nulls_last("created"), F.asc("id")], 1, 50).select("id", "updated")


def id_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the chunks, of the evidence, and in both."""
    a = read_table(spark, d, "chunks").select("rag_input_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = read_table(spark, d, "question_bank_candidate_evidence").select("rag_input_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = a.unionByName(b).filter("rag_input_id is not null").groupBy("rag_input_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.sum("a").alias("chunks"), F.sum("b").alias("evidence"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"))


def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The evidence ids of each candidate in their order, found or missing among the source chunks."""
    wanted = _candidates(spark, d).select(F.col("id").alias("candidate_id"), F.posexplode(V.string_list(F.col("evidence_refs_json"))).alias("pos", "rag_input_id"))
    table = _chunks(spark, d).filter("approved_for_rag_evidence = 1").select("rag_input_id", X.excerpt(F.col("content"), 80).alias("excerpt"))
    return store.looked_up(wanted, table, "rag_input_id").select("candidate_id", "pos", "rag_input_id", "lookup_status", F.coalesce("excerpt", F.lit("")).alias("excerpt"))


def hydrated_children(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their evidence by page and id and their validations by time and stage."""
    children = {
        "evidence": (_evidence(spark, d).withColumn("page", F.coalesce("page_or_slide", F.lit(0))), "candidate_id", ["page", "id"], ["rag_input_id"]),
        "validations": (_validations(spark, d), "candidate_id", ["created", "validation_stage", "id"], ["verdict"]),
    }
    rows = store.with_children(_candidates(spark, d).select("id"), "id", children)
    return rows.select("id", F.array_join(F.transform("evidence", lambda e: e["id"]), ",").alias("evidence"), F.array_join(F.transform("validations", lambda v: F.coalesce(v["verdict"], F.lit("none"))), ",").alias("verdicts"))


def first_scope_match(spark: SparkSession, d: str) -> DataFrame:
    """The first scope row with a chunk's subject, field, area and detail."""
    keys = ["subject", "field", "area", "detail"]
    rows = _chunks(spark, d).select("rag_input_id", *[F.col(f"mapped_{k}").alias(k) for k in keys])
    listed = read_table(spark, d, "exam_scope").select("id", *keys)
    return store.first_match(rows, small(listed), keys, F.col("id"), "id").select("rag_input_id", F.col("id").alias("scope_id"))


def scope_index(spark: SparkSession, d: str) -> DataFrame:
    """Scope rows listed by compacted subject, field and area."""
    rows = read_table(spark, d, "exam_scope")
    listed = F.array_join(F.array_sort(F.collect_list("id")), ",")
    return rows.groupBy(V.scope_key(F.col("subject"), F.col("field"), F.col("area")).alias("key")).agg(F.count("*").alias("n"), listed.alias("ids"))


def only_scope_match(spark: SparkSession, d: str) -> DataFrame:
    """Areas corrected only where a field has exactly one."""
    listed = read_table(spark, d, "exam_scope").select("subject", "field", F.col("area").alias("only_area"))
    rows = _candidates(spark, d).select("id", "subject", "field", "area")
    return store.only_match(rows, listed, ["subject", "field"], "only_area").select("id", F.coalesce("only_area", "area").alias("area"), F.col("only_area").isNotNull().alias("single"))


def changed_images(spark: SparkSession, d: str) -> DataFrame:
    """Scope of the chunks as their id says, with what it was before."""
    listed = read_table(spark, d, "exam_scope").select(F.col("id").alias("mapped_scope_id"), F.col("area").alias("new_area"), F.col("detail").alias("new_detail"))
    rows = _chunks(spark, d).select("rag_input_id", "mapped_scope_id", "mapped_area", "mapped_detail").join(small(listed), "mapped_scope_id")
    return store.with_images(rows, {"mapped_area": F.col("new_area"), "mapped_detail": F.col("new_detail")}).select("rag_input_id", "changed", F.col("before.mapped_area").alias("before_area"), F.col("after.mapped_area").alias("after_area"))


def linked_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Paths such as ``subject > field > area > detail`` taken apart and met with the scope list."""
    paths = _candidates(spark, d).select("id", F.split(F.concat_ws(" > ", "subject", "field", "area", "detail"), r"\s*>\s*").alias("p"))
    parts = paths.select("id", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("subject", "field", "area", "detail"))])
    listed = read_table(spark, d, "exam_scope").groupBy("subject", "field", "area", "detail").agg(F.min("id").alias("scope_id"))
    return parts.join(small(listed), ["subject", "field", "area", "detail"]).select("id", "scope_id")


def fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first of three ids of a candidate that is not blank."""
    key = F.coalesce(V.none_if_blank(F.col("revision_package_id")), V.none_if_blank(F.col("validation_package_id")), V.none_if_blank(F.col("package_id")))
    return _candidates(spark, d).select("id", F.coalesce(key, F.lit("none")).alias("key"))


def preferred_targets(spark: SparkSession, d: str) -> DataFrame:
    """Scope rows for each chunk: those of its detail, else of its area, else of its subject; at most five of the best tier."""
    rows = _chunks(spark, d).filter("mapped_subject is not null").select("rag_input_id", "mapped_subject", "mapped_area", "mapped_detail")
    listed = read_table(spark, d, "exam_scope").select("id", F.col("subject").alias("mapped_subject"), "area", "detail")
    tier = F.when(F.col("detail") == F.col("mapped_detail"), 0).when(F.col("area") == F.col("mapped_area"), 1).otherwise(2)
    met = rows.join(small(listed), "mapped_subject").select("rag_input_id", "id", tier.alias("tier"))
    least = met.groupBy("rag_input_id", "tier").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 5).alias("ids"))
    return least.groupBy("rag_input_id").agg(F.min("tier").alias("tier"), F.min_by("ids", "tier").alias("ids")).select("rag_input_id", "tier", F.array_join("ids", ",").alias("ids"))


def wide_audit(spark: SparkSession, d: str) -> DataFrame:
    """Twelve counters for every scope row, those without chunks too."""
    c = {
        "total": F.lit(True), "high": F.col("scope_mapping_confidence") == "high", "medium": F.col("scope_mapping_confidence") == "medium", "area_only": F.col("scope_mapping_confidence") == "area_only",
        "review": F.col("scope_mapping_needs_review") == 1, "approved": F.col("approved_for_rag_evidence") == 1, "generation": F.col("approved_for_generation") == 1, "good": F.col("extraction_quality") == "high",
        "ready": F.col("candidate_rag_status") == "ready_for_rag_evidence", "blank": F.coalesce(F.trim("content"), F.lit("")) == "", "long": F.length("content") > 500,
    }
    rows = _chunks(spark, d).groupBy(F.col("mapped_scope_id").alias("id")).agg(*[F.count_if(x).alias(n) for n, x in c.items()], F.count_distinct("source_file").alias("files"))
    scope = read_table(spark, d, "exam_scope").select("id")
    return scope.join(rows, "id", "left").na.fill(0)


def safety_summary(spark: SparkSession, d: str) -> DataFrame:
    """For each area its chunks by review flag, and the first twelve ids that need a review."""
    rows = _chunks(spark, d).filter("mapped_area is not null")
    first = top(rows.filter("scope_mapping_needs_review = 1"), ["mapped_area"], [F.asc("rag_input_id")], 12).groupBy("mapped_area").agg(F.array_join(F.array_sort(F.collect_list("rag_input_id")), ",").alias("first_refs"))
    status = rows.groupBy("mapped_area", F.coalesce("scope_mapping_status", F.lit("none")).alias("s")).agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda x: F.concat_ws(":", x["s"], x["n"].cast("string"))), ", ")
    histogram = status.groupBy("mapped_area").agg(F.sum("n").alias("n"), listed.alias("by_status"))
    return histogram.join(first, "mapped_area", "left").select("mapped_area", "n", "by_status", F.coalesce("first_refs", F.lit("")).alias("first_refs"))


def scope_packages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each scope as a package: the first row names it, six references at most."""
    rows = _chunks(spark, d).filter("mapped_scope_id <> ''")
    first = top(rows, ["mapped_scope_id"], [F.asc("source_file"), F.coalesce("page_or_slide", F.lit(0)), F.asc("rag_input_id")], 6)
    refs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "rag_input_id"))), lambda x: x["rag_input_id"])
    return first.groupBy("mapped_scope_id").agg(F.min_by("source_file", "rank").alias("seed_file"), F.array_join(refs, ",").alias("refs"))


def verdict_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Validations by verdict: broken summaries count as errors first, and every label has a row."""
    label = F.when(F.from_json("summary_json", "struct<score:double>")["score"].isNull(), "error").otherwise(F.coalesce("verdict", F.lit("none")))
    labels = spark.createDataFrame([(x,) for x in ("pass", "revise", "reject", "pending", "error", "none", "hold")], "verdict string")
    counted = _validations(spark, d).groupBy(label.alias("verdict")).agg(F.count("*").alias("n"))
    return labels.join(counted, "verdict", "left").na.fill(0, ["n"])


def stage_verdict_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the validation rows against their verdicts."""
    known = ["pass", "revise", "reject", "pending"]
    return _validations(spark, d).groupBy(F.col("validation_stage").alias("check")).pivot("verdict", known).count().na.fill(0)


def merged_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counts of verdicts by candidate, added up by subject."""
    counts = _validations(spark, d).groupBy("candidate_id", F.coalesce("verdict", F.lit("none")).alias("v")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("counts"))
    rows = maps.join(_candidates(spark, d).select(F.col("id").alias("candidate_id"), "subject"), "candidate_id")
    return S.merged_counts(rows, ["subject"], "counts")


def objective_votes(spark: SparkSession, d: str) -> DataFrame:
    """Objectives by the scores of their candidates' validations, a tenth a vote and one at least; the five best of each area."""
    score = F.coalesce(F.from_json("summary_json", "struct<score:double>")["score"], F.lit(0.0))
    votes = _validations(spark, d).select("candidate_id", F.greatest(F.lit(1), (score * 10).cast("int")).alias("votes"))
    rows = votes.join(_candidates(spark, d).select(F.col("id").alias("candidate_id"), "area", "learning_objective_id"), "candidate_id").dropna()
    total = rows.groupBy("area", "learning_objective_id").agg(F.sum("votes").alias("votes"))
    best = top(total, ["area"], [F.desc("votes"), F.asc("learning_objective_id")], 5)
    return best.select("area", "learning_objective_id", "votes", "rank", F.when(F.col("votes") >= 20, "high").when(F.col("votes") >= 10, "medium").otherwise("low").alias("confidence"))


def pair_quality(spark: SparkSession, d: str) -> DataFrame:
    """Lowest and mean score, shared words and different files of consecutive chunks of a scope."""
    rows = _chunks(spark, d).filter("mapped_scope_id <> '' and content is not null").select("mapped_scope_id", "source_file", "rag_input_id", (F.length("content") / 1000).alias("score"), F.array_distinct(X.tokens(F.col("content"))).alias("words"))
    pairs = S.consecutive_pairs(rows, ["mapped_scope_id"], [F.asc("rag_input_id")], ["rag_input_id", "source_file", "score", "words"])
    scores = F.array("score_1", "score_2")
    return pairs.select(
        "mapped_scope_id", "rag_input_id_1", "rag_input_id_2", F.array_min(scores).alias("least"), F.round((F.col("score_1") + F.col("score_2")) / 2, 4).alias("mean"),
        F.size(F.array_intersect("words_1", "words_2")).alias("shared"), F.size(F.array_distinct(F.array("source_file_1", "source_file_2"))).alias("files"),
    )


def finding_summary(spark: SparkSession, d: str) -> DataFrame:
    """Validations as findings: errors, warnings and notes of each candidate, and whether it passes."""
    kind = F.when(F.col("verdict") == "reject", "error").when(F.col("verdict") == "revise", "warning").otherwise("info")
    rows = _validations(spark, d).withColumn("kind", kind)
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("error", "warning", "info")]
    return rows.groupBy("candidate_id").agg(*counts, (F.count_if(F.col("kind") == "error") == 0).alias("overall_pass"))


def first_seen_lists(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and fields in the order in which the scope list names them."""
    rows = S.numbered(read_table(spark, d, "exam_scope"), [F.asc("source_page"), F.asc("id")], "pos")
    return S.first_seen(rows, ["subject", "field"], F.col("pos")).select("subject", "field", F.col("first").cast("bigint").alias("first"))


def document_records(spark: SparkSession, d: str) -> DataFrame:
    """Pages, pages with text, and the list of low pages of every document."""
    pages = _once(spark, d, "source_chunk").groupBy("document_id", F.col("page_start").alias("page")).agg(F.sum(F.length(F.coalesce("content", F.lit("")))).alias("size"))
    low = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("size") < 120, F.col("page")))), lambda p: p.cast("string")), ",")
    return pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("size") >= 120).alias("text_pages"), low.alias("low_pages"))


def scope_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The three scope rows of each chunk's subject that share most words with it."""
    words = _chunks(spark, d).filter("content is not null").select("rag_input_id", "mapped_subject", F.explode(F.array_distinct(X.tokens(F.col("content")))).alias("word"))
    listed = read_table(spark, d, "exam_scope").select("id", F.col("subject").alias("mapped_subject"), F.explode(F.array_distinct(X.tokens(F.col("detail")))).alias("word"))
    met = words.join(small(listed), ["mapped_subject", "word"]).groupBy("rag_input_id", "id").agg(F.count("*").alias("n"))
    best = S.best_list(met, ["rag_input_id"], [F.desc("n"), F.asc("id")], 3, ["id", "n"])
    return best.select("rag_input_id", F.array_join(F.transform("best", lambda b: F.concat_ws(":", b["id"], b["n"].cast("string"))), ",").alias("candidates"))


def area_top(spark: SparkSession, d: str) -> DataFrame:
    """The three details of each area with most references, then most pages."""
    rows = _chunks(spark, d).filter("mapped_area is not null and mapped_detail is not null").groupBy("mapped_area", "mapped_detail").agg(F.count("*").alias("refs"), F.count_distinct("page_or_slide").alias("pages"))
    return top(rows, ["mapped_area"], [F.desc("refs"), F.desc("pages"), F.asc("mapped_detail")], 3)


def quota_backfill(spark: SparkSession, d: str) -> DataFrame:
    """What the periods are short of after the quotas, from the candidates that fill none."""
    from granary.plans.tables import quota_fill

    pool = _candidates(spark, d).filter("status = 'expert_passed' and period is not null").select("id", "period", "source_stage")
    taken = pool.join(quota_fill(spark, d).select("id"), "id", "left_semi")
    targets = read_table(spark, d, "exam_scope").groupBy("period").agg(F.sum("question_count").alias("target"))
    return S.backfilled(pool, taken, targets, "period", "id", "target", [_stage(), F.sha2("id", 256)]).select("period", "id")


def shortage_take(spark: SparkSession, d: str) -> DataFrame:
    """As many pending candidates of each scope as it lacks passed ones."""
    rows = _candidates(spark, d).filter("scope_id is not null").select("id", "scope_id", "status")
    have = rows.filter("status = 'expert_passed'").groupBy("scope_id").agg(F.count("*").alias("have"))
    listed = read_table(spark, d, "exam_scope").filter("question_count is not null").select(F.col("id").alias("scope_id"), "question_count")
    short = listed.join(have, "scope_id", "left").select("scope_id", (F.col("question_count") - F.coalesce("have", F.lit(0))).alias("short"))
    return S.fill_quota(rows.filter("status = 'pending_expert_review'"), short, ["scope_id"], "short", [F.asc("id")]).select("scope_id", "id")


def round_robin_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants for every question a scope row wants, types, difficulties and angles in turn."""
    rows = read_table(spark, d, "exam_scope").select("id", F.coalesce("question_count", F.lit(0)).alias("n"))
    choices = {"kind": ["concept", "apply", "compare", "compute"], "level": ["low", "middle", "high"], "angle": ["cause", "effect"]}
    return S.expanded(rows, F.col("n"), choices).select("id", "variant", *choices)


def filled_cells(spark: SparkSession, d: str) -> DataFrame:
    """Merged cells of the scope list, blanked and filled again: a new subject ends field and area, a new field the area."""
    rows = read_table(spark, d, "exam_scope").select("id", "period", *[F.when(F.pmod(F.conv(F.substring(F.sha2(F.concat("id", F.lit(c)), 256), 1, 4), 16, 10).cast("int"), F.lit(3)) == 0, F.col(c)).alias(c) for c in ("subject", "field", "area")])
    return S.filled_down(rows, ["subject", "field", "area"], ["period"], [F.asc("id")]).select("id", "subject", "field", "area")


def headed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents under their numbered headings."""
    lines = read_table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = S.under_headings(lines, "line", {"part": r"^제 ?(\d+) ?장", "unit": r"^(\d{1,2})\. "}, ["doc_id"], [F.asc("pos")])
    return found.groupBy("doc_id", "part", "unit").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def page_samples(spark: SparkSession, d: str) -> DataFrame:
    """Six pages of each document, evenly spaced after four of front matter, and the strip of page numbers at page 12."""
    rows = read_table(spark, d, "source_document").select("id", F.coalesce("page_count", F.lit(0)).alias("n"))
    listed = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return rows.select("id", listed(S.evenly_spaced(F.col("n"), 6, 4)).alias("sample"), listed(S.page_strip(F.lit(12), F.col("n"))).alias("strip"))


def numbered_scopes(spark: SparkSession, d: str) -> DataFrame:
    rows = S.numbered(read_table(spark, d, "exam_scope").select("id", "subject", "area"), [F.asc("subject"), F.asc("area"), F.asc("id")], "n")
    return rows.select("id", F.format_string("scope-%04d", "n").alias("number"))


def over_fetched(spark: SparkSession, d: str) -> DataFrame:
    """Of the first twelve chunks of each scope those not used as evidence, three at most."""
    used = read_table(spark, d, "question_bank_candidate_evidence").select("rag_input_id").dropna().distinct().withColumn("used", F.lit(True))
    rows = _chunks(spark, d).filter("mapped_scope_id <> ''").join(used, "rag_input_id", "left")
    order = [_band("scope_mapping_confidence"), F.coalesce("page_or_slide", F.lit(0)), F.asc("rag_input_id")]
    return S.over_fetched(rows, ["mapped_scope_id"], order, 3, F.col("used").isNull()).select("mapped_scope_id", "rag_input_id", "rank")


def report_order(spark: SparkSession, d: str) -> DataFrame:
    """Scope rows by six keys, numbered in this order: priority, missing questions, then names."""
    made = _candidates(spark, d).groupBy(F.col("scope_id").alias("id")).agg(F.count("*").alias("made"))
    rows = read_table(spark, d, "exam_scope").join(made, "id", "left").withColumn("missing", F.coalesce("question_count", F.lit(0)) - F.coalesce("made", F.lit(0)))
    priority = F.when(F.col("missing") > 2, "high").when(F.col("missing") > 0, "medium").otherwise("low")
    order = [F.when(F.col("missing") > 2, 0).when(F.col("missing") > 0, 1).otherwise(2), F.desc("missing"), F.asc("period"), F.asc("subject"), F.asc("area"), F.asc("id")]
    return S.numbered(rows, order, "place").select("id", priority.alias("priority"), F.col("place").cast("bigint").alias("place"))


def batch_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """Forty candidates from the twenty-first on, by file order of their review."""
    return S.batch_of(_evidence(spark, d), [F.asc("source_file"), F.coalesce("page_or_slide", F.lit(0)), F.asc("id")], 20, 40).select("id", "source_file")


def groups_by_size(spark: SparkSession, d: str) -> DataFrame:
    return S.group_order(_chunks(spark, d).filter("mapped_detail is not null"), ["mapped_detail"]).select("mapped_detail", "n", F.col("rank").cast("bigint").alias("rank"))


def scope_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of one area by confidence, then page."""
    rows = _chunks(spark, d).filter("mapped_subject = '영상검사학' and mapped_field = '단면 영상'")
    return rows.orderBy(_band("scope_mapping_confidence"), F.coalesce("page_or_slide", F.lit(0)), "rag_input_id").limit(25).select("rag_input_id", "scope_mapping_confidence")


def picked_package(spark: SparkSession, d: str) -> DataFrame:
    """The first safe candidate, or else that at an index."""
    return S.picked(_candidates(spark, d), "id", None, (F.col("status") == "expert_passed") & (F.col("difficulty") == "상"), [F.asc("id")], 3).select("id", "status")


def subset_test(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose evidence lies within the approved chunks, and those where some doesn't."""
    approved = _chunks(spark, d).filter("approved_for_rag_evidence = 1").select("rag_input_id", F.lit(1).alias("ok"))
    rows = _evidence(spark, d).filter("rag_input_id is not null").join(approved, "rag_input_id", "left").groupBy("candidate_id").agg((F.count("*") == F.count("ok")).alias("subset"))
    return rows.groupBy("subset").agg(F.count("*").alias("n"))


def pass_fail_parts(spark: SparkSession, d: str) -> DataFrame:
    passed, failed = store.partitioned(_validations(spark, d), F.col("passed") == 1)
    return passed.agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("part", F.lit("pass")).unionByName(failed.agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("part", F.lit("fail")))


def composite_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first evidence of each candidate, file and scope; and of scope names the distinct ones."""
    rows = _evidence(spark, d).filter("source_file is not null and mapped_scope_id is not null")
    return S.first_per_key(rows, ["candidate_id", "source_file", "mapped_scope_id"], [F.asc("id")]).select("candidate_id", "source_file", "mapped_scope_id", "id")


def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """A store after an insert, an update, a deletion and an upsert by two keys."""
    scope = read_table(spark, d, "exam_scope").select("id", "subject", "area", "question_count")
    fresh = scope.filter("question_count = 2").select(F.concat("id", F.lit("_new")).alias("id"), "subject", "area", F.lit(7).alias("question_count"))
    rows = store.inserted(scope, fresh, "id")
    rows = store.updated(rows, F.col("question_count") == 1, {"question_count": F.lit(11)}, None)
    rows = store.deleted(rows, {"question_count": 3})
    again = scope.filter("question_count = 2").select("id", "subject", F.lit("changed").alias("area"), F.lit(0).alias("question_count"))
    return store.with_defaults(store.upserted_by(rows, again, ["id", "subject"]), {"state": F.lit("open")})


def synced_scope(spark: SparkSession, d: str) -> DataFrame:
    """The candidates' scopes as the new list: those it lacks go, and counts are kept."""
    old = read_table(spark, d, "exam_scope").select("id", "area", "question_count")
    new = _candidates(spark, d).filter("scope_id is not null").groupBy(F.col("scope_id").alias("id")).agg(F.min("area").alias("area"), F.lit(0).alias("question_count"))
    return store.synced(old, new, "id", ["question_count"])


def answer_updates(spark: SparkSession, d: str) -> DataFrame:
    """What a batch of new answer positions would change."""
    rows = _candidates(spark, d).filter("answer between 1 and 5").select("id", "answer")
    updates = rows.select("id", (V.hash_modulo(F.col("id"), 5) + 1).alias("answer"))
    return store.applied_updates(rows, updates, "id", ["answer"], dry=True)


def event_status(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the candidates as their last validation says."""
    rows = _candidates(spark, d).select("id", F.lit("new").alias("verdict"))
    events = _validations(spark, d).select(F.col("candidate_id").alias("id"), "verdict", "created", F.col("id").alias("event"))
    return store.with_event(rows, events, "id", [F.desc_nulls_last("created"), F.desc("event")], "verdict")


def index_manifest(spark: SparkSession, d: str) -> DataFrame:
    return index.manifest(_chunks(spark, d), ["candidate_rag_status", "mapped_area", "source_file"])


def index_integrity(spark: SparkSession, d: str) -> DataFrame:
    return index.integrity(_chunks(spark, d), "rag_input_id", {"approved_for_generation": 0}, "source_path")


def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Source documents' chunks as one page each, in order."""
    from granary.sources.jsonl import pages_dump

    rows = _once(spark, d, "source_chunk").select("document_id", F.concat_ws("-", F.format_string("%05d", F.coalesce("chunk_index", F.lit(0))), "id").alias("page"), "content")
    return pages_dump(rows, "document_id", "page", "content").select("document_id", F.sha2("markdown", 256).alias("markdown"))


def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a scope in pairs from different files, the longest first, four pairs at most."""
    rows = _chunks(spark, d).filter("mapped_scope_id <> ''").select("mapped_scope_id", "rag_input_id", "source_file", F.length("content").cast("double").alias("score"))
    return S.distinct_pairs(rows, "mapped_scope_id", "rag_input_id", "source_file", "score", 4)


def drawn_sample(spark: SparkSession, d: str) -> DataFrame:
    """Thirty candidates drawn by a seed."""
    return S.sampled(_candidates(spark, d).filter("status <> ''"), "id", 30, 7).select("id")


QUERIES = {
    f.__name__: f
    for f in (
        built_conditions, built_groups, built_counts, admin_list, id_set_overlap, ordered_lookup, hydrated_children, first_scope_match, scope_index, only_scope_match, changed_images, linked_scopes, fallback_lookup,
        preferred_targets, wide_audit, safety_summary, scope_packages, verdict_precedence, stage_verdict_matrix, merged_counters, objective_votes, pair_quality, finding_summary, first_seen_lists, document_records,
        scope_candidates, area_top, quota_backfill, shortage_take, round_robin_variants, filled_cells, headed_lines, page_samples, numbered_scopes, over_fetched, report_order, batch_of_rows, groups_by_size,
        scope_search, picked_package, subset_test, pass_fail_parts, composite_dedupe, store_changes, synced_scope, answer_updates, event_status, index_manifest, index_integrity, page_markdown, distinct_pairs, drawn_sample,
    )
}

_C = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate)"
_E = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate_evidence)"
_V = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate_validation)"
_K = "(SELECT DISTINCT ON (rag_input_id) * FROM chunks)"
_S = "(SELECT DISTINCT ON (id) * FROM source_chunk)"
_BAND = "CASE scope_mapping_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_STAGE = "CASE source_stage WHEN 'revised_pass' THEN 0 WHEN 'quota_pass' THEN 1 WHEN 'initial_pass' THEN 2 ELSE 8 END, sha256(id)"
_FILL = f"""(SELECT c.id FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY {_STAGE}) AS n FROM {_C} WHERE status = 'expert_passed' AND scope_id IS NOT NULL) c JOIN exam_scope s ON s.id = c.scope_id WHERE c.n <= s.question_count)"""
_FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"
_KEY = "lower(regexp_replace(coalesce({0}, ''), '[^0-9A-Za-z가-힣]+', '', 'g'))"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[0-9a-z가-힣]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+')))"
_SCORE = "CASE WHEN json_valid(summary_json) THEN CAST(json_extract_string(summary_json, '$.score') AS DOUBLE) END"


def _cell(c: str) -> str:
    return f"CASE WHEN CAST(('0x' || left(sha256(id || '{c}'), 4)) AS INT) % 3 = 0 THEN {c} END AS {c}"


SQL = {
    "built_conditions": f"""SELECT id, subject, answer FROM {_C} WHERE source_stage IN ('initial_pass', 'revised_pass') AND status <> 'rejected' AND contains(stem, '다') AND answer BETWEEN 2 AND 4 AND (period = '1교시' OR difficulty = '상') ORDER BY id LIMIT 30 OFFSET 30""",
    "built_groups": f"SELECT subject, period, count(*) AS n FROM {_C} WHERE status IN ('expert_passed', 'pending_expert_review') GROUP BY ALL",
    "built_counts": f"SELECT 'rows' AS kind, count(*) AS n FROM {_C} WHERE status = 'rejected' UNION ALL SELECT 'groups', count(*) FROM (SELECT DISTINCT subject, area FROM {_C} WHERE status = 'rejected')",
    "admin_list": f"""SELECT id, updated FROM {_C} WHERE status <> 'rejected' AND subject = '영상검사학' AND period = '2교시' AND source_stage = 'initial_pass' AND concat_ws(chr(1), stem, explanation, area, detail, id) LIKE '%초음파%'
        ORDER BY updated DESC NULLS LAST, created DESC NULLS LAST, id LIMIT 50""",
    "id_set_overlap": """WITH a AS (SELECT DISTINCT rag_input_id FROM chunks), b AS (SELECT DISTINCT rag_input_id FROM question_bank_candidate_evidence WHERE rag_input_id IS NOT NULL)
        SELECT (SELECT count(*) FROM a) AS chunks, (SELECT count(*) FROM b) AS evidence, (SELECT count(*) FROM a JOIN b USING (rag_input_id)) AS both""",
    "ordered_lookup": f"""WITH w AS (SELECT id AS candidate_id, CASE WHEN json_valid(evidence_refs_json) THEN json_extract_string(evidence_refs_json, '$[*]') ELSE [] END AS l FROM {_C}), p AS (SELECT candidate_id, l, unnest(range(1, len(l) + 1)) AS i FROM w),
        t AS (SELECT rag_input_id, {_FLAT.format('content')} AS x FROM {_K} WHERE approved_for_rag_evidence = 1)
        SELECT candidate_id, CAST(i - 1 AS INT) AS pos, l[i] AS rag_input_id, CASE WHEN t.rag_input_id IS NULL THEN 'missing' ELSE 'found' END AS lookup_status, coalesce(CASE WHEN length(x) > 80 THEN rtrim(left(x, 80), ' ') || '...' ELSE x END, '') AS excerpt
        FROM p LEFT JOIN t ON t.rag_input_id = l[i]""",
    "hydrated_children": f"""WITH e AS (SELECT candidate_id, string_agg(id, ',' ORDER BY coalesce(page_or_slide, 0), id) AS e FROM {_E} GROUP BY 1), v AS (SELECT candidate_id, string_agg(coalesce(verdict, 'none'), ',' ORDER BY created NULLS FIRST, validation_stage, id) AS v FROM {_V} GROUP BY 1)
        SELECT id, coalesce(e, '') AS evidence, coalesce(v, '') AS verdicts FROM {_C} c LEFT JOIN e ON e.candidate_id = id LEFT JOIN v ON v.candidate_id = id""",
    "first_scope_match": f"SELECT rag_input_id, min(s.id) AS scope_id FROM {_K} c LEFT JOIN exam_scope s ON s.subject = mapped_subject AND s.field = mapped_field AND s.area = mapped_area AND s.detail = mapped_detail GROUP BY 1",
    "scope_index": f"SELECT {_KEY.format('subject')} || '|' || {_KEY.format('field')} || '|' || {_KEY.format('area')} AS key, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM exam_scope GROUP BY 1",
    "only_scope_match": f"""WITH o AS (SELECT subject, field, min(area) AS a FROM exam_scope GROUP BY ALL HAVING count(DISTINCT area) = 1) SELECT c.id, coalesce(o.a, c.area) AS area, o.a IS NOT NULL AS single FROM {_C} c LEFT JOIN o ON o.subject = c.subject AND o.field = c.field""",
    "changed_images": f"SELECT rag_input_id, mapped_area IS DISTINCT FROM s.area OR mapped_detail IS DISTINCT FROM s.detail AS changed, mapped_area AS before_area, s.area AS after_area FROM {_K} c JOIN exam_scope s ON s.id = mapped_scope_id",
    "linked_scopes": f"SELECT c.id, min(s.id) AS scope_id FROM {_C} c JOIN exam_scope s ON s.subject = c.subject AND s.field = c.field AND s.area = c.area AND s.detail = c.detail GROUP BY 1",
    "fallback_lookup": f"SELECT id, CASE WHEN trim(revision_package_id, ' ') <> '' THEN revision_package_id WHEN trim(validation_package_id, ' ') <> '' THEN validation_package_id WHEN trim(package_id, ' ') <> '' THEN package_id ELSE 'none' END AS key FROM {_C}",
    "preferred_targets": f"""WITH p AS (SELECT rag_input_id, s.id, CASE WHEN s.detail = mapped_detail THEN 0 WHEN s.area = mapped_area THEN 1 ELSE 2 END AS tier FROM {_K} c JOIN exam_scope s ON s.subject = mapped_subject),
        r AS (SELECT *, min(tier) OVER (PARTITION BY rag_input_id) AS least, row_number() OVER (PARTITION BY rag_input_id, tier ORDER BY id) AS n FROM p)
        SELECT rag_input_id, CAST(tier AS INT) AS tier, string_agg(id, ',' ORDER BY id) AS ids FROM r WHERE tier = least AND n <= 5 GROUP BY ALL""",
    "wide_audit": f"""SELECT s.id, count(rag_input_id) AS total, count(*) FILTER (scope_mapping_confidence = 'high') AS high, count(*) FILTER (scope_mapping_confidence = 'medium') AS medium, count(*) FILTER (scope_mapping_confidence = 'area_only') AS area_only,
        count(*) FILTER (scope_mapping_needs_review = 1) AS review, count(*) FILTER (approved_for_rag_evidence = 1) AS approved, count(*) FILTER (approved_for_generation = 1) AS generation, count(*) FILTER (extraction_quality = 'high') AS good,
        count(*) FILTER (candidate_rag_status = 'ready_for_rag_evidence') AS ready, count(*) FILTER (rag_input_id IS NOT NULL AND coalesce(trim(content, ' '), '') = '') AS blank, count(*) FILTER (length(content) > 500) AS long, count(DISTINCT source_file) AS files
        FROM exam_scope s LEFT JOIN {_K} c ON mapped_scope_id = s.id GROUP BY s.id""",
    "safety_summary": f"""WITH c AS (SELECT * FROM {_K} WHERE mapped_area IS NOT NULL), h AS (SELECT mapped_area, coalesce(scope_mapping_status, 'none') AS s, count(*) AS n FROM c GROUP BY ALL),
        f AS (SELECT mapped_area, rag_input_id, row_number() OVER (PARTITION BY mapped_area ORDER BY rag_input_id) AS k FROM c WHERE scope_mapping_needs_review = 1), g AS (SELECT mapped_area, string_agg(rag_input_id, ',' ORDER BY k) AS r FROM f WHERE k <= 12 GROUP BY 1)
        SELECT h.mapped_area, CAST(sum(n) AS BIGINT) AS n, string_agg(concat_ws(':', s, n), ', ' ORDER BY s) AS by_status, coalesce(any_value(r), '') AS first_refs FROM h LEFT JOIN g ON g.mapped_area = h.mapped_area GROUP BY 1""",
    "scope_packages": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY mapped_scope_id ORDER BY source_file NULLS FIRST, coalesce(page_or_slide, 0), rag_input_id) AS n FROM {_K} WHERE mapped_scope_id <> '')
        SELECT mapped_scope_id, arg_min(source_file, n) AS seed_file, string_agg(rag_input_id, ',' ORDER BY n) AS refs FROM r WHERE n <= 6 GROUP BY 1""",
    "verdict_precedence": f"""WITH c AS (SELECT CASE WHEN {_SCORE} IS NULL THEN 'error' ELSE coalesce(verdict, 'none') END AS v FROM {_V})
        SELECT l.v AS verdict, count(c.v) AS n FROM (SELECT unnest(['pass', 'revise', 'reject', 'pending', 'error', 'none', 'hold']) AS v) l LEFT JOIN c ON c.v = l.v GROUP BY 1""",
    "stage_verdict_matrix": f"""SELECT validation_stage AS "check", count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'revise') AS revise, count(*) FILTER (verdict = 'reject') AS reject, count(*) FILTER (verdict = 'pending') AS pending FROM {_V} GROUP BY 1""",
    "merged_counters": f"SELECT subject, coalesce(verdict, 'none') AS name, count(*) AS n FROM {_V} v JOIN {_C} c ON c.id = candidate_id GROUP BY ALL",
    "objective_votes": f"""WITH t AS (SELECT area, learning_objective_id, CAST(sum(greatest(1, CAST(trunc(coalesce({_SCORE}, 0) * 10) AS INT))) AS BIGINT) AS votes FROM {_V} v JOIN {_C} c ON c.id = candidate_id WHERE area IS NOT NULL AND learning_objective_id IS NOT NULL GROUP BY ALL)
        SELECT area, learning_objective_id, votes, CAST(row_number() OVER w AS INT) AS rank, CASE WHEN votes >= 20 THEN 'high' WHEN votes >= 10 THEN 'medium' ELSE 'low' END AS confidence FROM t
        WINDOW w AS (PARTITION BY area ORDER BY votes DESC, learning_objective_id) QUALIFY row_number() OVER w <= 5""",
    "pair_quality": f"""WITH t AS (SELECT mapped_scope_id, rag_input_id, source_file, length(content) / 1000 AS score, {_WORDS.format('content')} AS w, row_number() OVER (PARTITION BY mapped_scope_id ORDER BY rag_input_id) - 1 AS n FROM {_K} WHERE mapped_scope_id <> '' AND content IS NOT NULL)
        SELECT a.mapped_scope_id, a.rag_input_id AS rag_input_id_1, b.rag_input_id AS rag_input_id_2, least(a.score, b.score) AS least, round((a.score + b.score) / 2, 4) AS mean, CAST(len(list_intersect(a.w, b.w)) AS INT) AS shared, CASE WHEN a.source_file = b.source_file THEN 1 ELSE 2 END AS files
        FROM t a JOIN t b ON b.mapped_scope_id = a.mapped_scope_id AND b.n = a.n + 1 WHERE a.n % 2 = 0""",
    "finding_summary": f"SELECT candidate_id, count(*) FILTER (verdict = 'reject') AS error, count(*) FILTER (verdict = 'revise') AS warning, count(*) FILTER (verdict IS NULL OR verdict NOT IN ('reject', 'revise')) AS info, count(*) FILTER (verdict = 'reject') = 0 AS overall_pass FROM {_V} GROUP BY 1",
    "first_seen_lists": "SELECT subject, field, min(n) AS first FROM (SELECT subject, field, row_number() OVER (ORDER BY source_page NULLS FIRST, id) AS n FROM exam_scope) GROUP BY ALL",
    "document_records": f"""WITH p AS (SELECT document_id, page_start AS page, sum(length(coalesce(content, ''))) AS size FROM {_S} GROUP BY ALL)
        SELECT document_id, count(*) AS pages, count(*) FILTER (size >= 120) AS text_pages, coalesce(string_agg(page, ',' ORDER BY page) FILTER (size < 120 AND page IS NOT NULL), '') AS low_pages FROM p GROUP BY 1""",
    "scope_candidates": f"""WITH p AS (SELECT rag_input_id, s.id, len(list_intersect({_WORDS.format('content')}, {_WORDS.format('s.detail')})) AS n FROM {_K} c JOIN exam_scope s ON s.subject = mapped_subject WHERE content IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY rag_input_id ORDER BY n DESC, id) AS k FROM p WHERE n > 0) SELECT rag_input_id, string_agg(id || ':' || n, ',' ORDER BY k) AS candidates FROM r WHERE k <= 3 GROUP BY 1""",
    "area_top": f"""WITH t AS (SELECT mapped_area, mapped_detail, count(*) AS refs, count(DISTINCT page_or_slide) AS pages FROM {_K} WHERE mapped_area IS NOT NULL AND mapped_detail IS NOT NULL GROUP BY ALL)
        SELECT *, CAST(row_number() OVER w AS INT) AS rank FROM t WINDOW w AS (PARTITION BY mapped_area ORDER BY refs DESC, pages DESC, mapped_detail) QUALIFY row_number() OVER w <= 3""",
    "quota_backfill": f"""WITH pool AS (SELECT * FROM {_C} WHERE status = 'expert_passed' AND period IS NOT NULL), taken AS (SELECT * FROM pool WHERE id IN (SELECT id FROM {_FILL})),
        s AS (SELECT t.period, t.target - coalesce(h.n, 0) AS short FROM (SELECT period, sum(question_count) AS target FROM exam_scope GROUP BY 1) t LEFT JOIN (SELECT period, count(*) AS n FROM taken GROUP BY 1) h USING (period)),
        r AS (SELECT period, id, row_number() OVER (PARTITION BY period ORDER BY {_STAGE}) AS n FROM pool WHERE id NOT IN (SELECT id FROM taken)) SELECT period, id FROM r JOIN s USING (period) WHERE n <= short""",
    "shortage_take": f"""WITH h AS (SELECT s.id, question_count - count(c.id) AS short FROM exam_scope s LEFT JOIN {_C} c ON c.scope_id = s.id AND c.status = 'expert_passed' WHERE question_count IS NOT NULL GROUP BY s.id, question_count),
        r AS (SELECT scope_id, id, row_number() OVER (PARTITION BY scope_id ORDER BY id) AS n FROM {_C} WHERE status = 'pending_expert_review') SELECT scope_id, r.id FROM r JOIN h ON h.id = scope_id WHERE n <= short""",
    "round_robin_variants": """SELECT id, CAST(i AS INT) AS variant, (['concept', 'apply', 'compare', 'compute'])[i % 4 + 1] AS kind, (['low', 'middle', 'high'])[i % 3 + 1] AS level, (['cause', 'effect'])[i % 2 + 1] AS angle FROM (SELECT id, unnest(range(0, coalesce(question_count, 0))) AS i FROM exam_scope)""",
    "filled_cells": f"""WITH t AS (SELECT id, period, {_cell('subject')}, {_cell('field')}, {_cell('area')} FROM exam_scope),
        a AS (SELECT id, period, field, area, last_value(subject IGNORE NULLS) OVER w AS subject, count(subject) OVER w AS g0 FROM t WINDOW w AS (PARTITION BY period ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        b AS (SELECT id, period, area, subject, g0, last_value(field IGNORE NULLS) OVER w AS field, count(field) OVER w AS g1 FROM a WINDOW w AS (PARTITION BY period, g0 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT id, subject, field, last_value(area IGNORE NULLS) OVER (PARTITION BY period, g0, g1 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS area FROM b""",
    "headed_lines": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, l[i] AS line, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
        h AS (SELECT *, nullif(regexp_extract(line, '^제 ?([0-9]+) ?장', 1), '') AS p0, nullif(regexp_extract(line, '^([0-9]{1,2})\. ', 1), '') AS u0 FROM p),
        a AS (SELECT *, last_value(p0 IGNORE NULLS) OVER w AS part, count(p0) OVER w AS g FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        b AS (SELECT *, last_value(u0 IGNORE NULLS) OVER (PARTITION BY doc_id, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit FROM a)
        SELECT doc_id, part, unit, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM b WHERE p0 IS NULL AND u0 IS NULL GROUP BY ALL""",
    "page_samples": """WITH t AS (SELECT id, coalesce(page_count, 0) AS n FROM source_document)
        SELECT id, CASE WHEN n <= 4 THEN '' WHEN n - 4 <= 6 THEN array_to_string(range(4, n), ',') ELSE array_to_string([4 + CAST(floor(i * (n - 5) / 5.0 + 0.5) AS INT) for i in range(0, 6)], ',') END AS sample,
        CASE WHEN n >= 11 THEN array_to_string(range(11, least(n, 20) + 1), ',') ELSE '' END AS strip FROM t""",
    "numbered_scopes": "SELECT id, printf('scope-%04d', row_number() OVER (ORDER BY subject NULLS FIRST, area NULLS FIRST, id)) AS number FROM exam_scope",
    "over_fetched": f"""WITH r AS (SELECT mapped_scope_id, rag_input_id, row_number() OVER (PARTITION BY mapped_scope_id ORDER BY {_BAND}, coalesce(page_or_slide, 0), rag_input_id) AS n FROM {_K} WHERE mapped_scope_id <> ''),
        k AS (SELECT mapped_scope_id, rag_input_id, row_number() OVER (PARTITION BY mapped_scope_id ORDER BY n) AS rank FROM r WHERE n <= 12 AND rag_input_id NOT IN (SELECT rag_input_id FROM question_bank_candidate_evidence WHERE rag_input_id IS NOT NULL))
        SELECT mapped_scope_id, rag_input_id, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3""",
    "report_order": f"""WITH t AS (SELECT s.*, coalesce(question_count, 0) - coalesce(n, 0) AS missing FROM exam_scope s LEFT JOIN (SELECT scope_id, count(*) AS n FROM {_C} GROUP BY 1) c ON c.scope_id = s.id)
        SELECT id, CASE WHEN missing > 2 THEN 'high' WHEN missing > 0 THEN 'medium' ELSE 'low' END AS priority, row_number() OVER (ORDER BY CASE WHEN missing > 2 THEN 0 WHEN missing > 0 THEN 1 ELSE 2 END, missing DESC, period NULLS FIRST, subject NULLS FIRST, area NULLS FIRST, id) AS place FROM t""",
    "batch_of_rows": f"SELECT id, source_file FROM {_E} ORDER BY source_file NULLS FIRST, coalesce(page_or_slide, 0), id LIMIT 40 OFFSET 20",
    "groups_by_size": f"SELECT mapped_detail, n, row_number() OVER (ORDER BY n DESC, mapped_detail) AS rank FROM (SELECT mapped_detail, count(*) AS n FROM {_K} WHERE mapped_detail IS NOT NULL GROUP BY 1)",
    "scope_search": f"SELECT rag_input_id, scope_mapping_confidence FROM {_K} WHERE mapped_subject = '영상검사학' AND mapped_field = '단면 영상' ORDER BY {_BAND}, coalesce(page_or_slide, 0), rag_input_id LIMIT 25",
    "picked_package": f"SELECT id, status FROM (SELECT id, status, 0 AS t FROM {_C} WHERE status = 'expert_passed' AND difficulty = '상' ORDER BY id LIMIT 1) UNION ALL SELECT id, status FROM (SELECT id, status FROM {_C} ORDER BY id LIMIT 1 OFFSET 3) WHERE NOT EXISTS (SELECT 1 FROM {_C} WHERE status = 'expert_passed' AND difficulty = '상')",
    "subset_test": f"""WITH t AS (SELECT candidate_id, bool_and(rag_input_id IN (SELECT rag_input_id FROM chunks WHERE approved_for_rag_evidence = 1)) AS subset FROM {_E} WHERE rag_input_id IS NOT NULL GROUP BY 1) SELECT subset, count(*) AS n FROM t GROUP BY 1""",
    "pass_fail_parts": f"SELECT CASE WHEN passed = 1 THEN 'pass' ELSE 'fail' END AS part, count(*) AS n, min(id) AS first FROM {_V} GROUP BY 1",
    "composite_dedupe": f"SELECT candidate_id, source_file, mapped_scope_id, min(id) AS id FROM {_E} WHERE source_file IS NOT NULL AND mapped_scope_id IS NOT NULL GROUP BY ALL",
    "store_changes": """SELECT id, subject, CASE WHEN question_count = 2 THEN 'changed' ELSE area END AS area, CASE question_count WHEN 1 THEN 11 WHEN 2 THEN 0 ELSE question_count END AS question_count, 'open' AS state FROM exam_scope WHERE question_count IS DISTINCT FROM 3
        UNION ALL SELECT id || '_new', subject, area, 7, 'open' FROM exam_scope WHERE question_count = 2""",
    "synced_scope": f"SELECT c.id, c.area, CASE WHEN s.id IS NULL THEN 0 ELSE s.question_count END AS question_count FROM (SELECT scope_id AS id, min(area) AS area FROM {_C} WHERE scope_id IS NOT NULL GROUP BY 1) c LEFT JOIN exam_scope s ON s.id = c.id",
    "answer_updates": f"SELECT id, answer AS old_answer, CAST(('0x' || left(sha256(id), 16))::UBIGINT % 5 + 1 AS INT) AS new_answer FROM {_C} WHERE answer BETWEEN 1 AND 5 AND answer <> CAST(('0x' || left(sha256(id), 16))::UBIGINT % 5 + 1 AS INT)",
    "event_status": f"""WITH l AS (SELECT candidate_id, verdict FROM {_V} QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY created DESC NULLS LAST, id DESC) = 1) SELECT c.id, coalesce(l.verdict, 'new') AS verdict FROM {_C} c LEFT JOIN l ON l.candidate_id = c.id""",
    "index_manifest": " UNION ALL ".join(f"""SELECT '{c}' AS "column", coalesce({c}, '') AS value, count(*) AS n FROM {_K} GROUP BY 2""" for c in ("candidate_rag_status", "mapped_area", "source_file")),
    "index_integrity": f"SELECT count(*) AS rows, count(DISTINCT rag_input_id) AS keys, count(*) FILTER (approved_for_generation IS DISTINCT FROM 0) AS policy_mismatches, count(*) FILTER (coalesce(trim(source_path, ' '), '') = '') AS missing_paths FROM {_K}",
    "page_markdown": f"""SELECT document_id, sha256('# ' || document_id || chr(10) || chr(10) || string_agg('## ' || p || chr(10) || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY p)) AS markdown FROM (SELECT *, printf('%05d', coalesce(chunk_index, 0)) || '-' || id AS p FROM {_S}) GROUP BY document_id""",
}
