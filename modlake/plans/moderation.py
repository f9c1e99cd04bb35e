"""Queries of spans, media, pictures, training rows, highlights and the blocklist; importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..operators import audit, blocklist, gate, highlights, media, noise, occlusion, pictures, policy, reports, training, vision
from .queries import LOG, SCORED, UNIT, Tables, query
from .reports import SPLIT, SQL_KEY

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
words = lambda c="text": F.filter(F.split(c, r"\s+"), lambda w: w != "")


# -- spans -------------------------------------------------------------------------------------------------------------
PIECES = r"list_transform(list_filter(regexp_split_to_array({0}, '\n|[।॥]+|[.!?]+(\s|$)'), lambda s: regexp_matches(s, '[\pL\pN\pM_]')), lambda s: regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', ''))"
query("p3_sentences", "SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS m FROM (SELECT doc_id, " + PIECES.format("text") + " AS s FROM documents)")(
    lambda t: t.documents.select("doc_id", spans.said_sentences("text").alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s.own", "|")).alias("m")))
query("p4_p5_p6_scan_units", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents), s AS (SELECT doc_id, ln, unnest(" + PIECES.format("line") + ") AS s, generate_subscripts(" + PIECES.format("line") + r""", 1) AS k FROM l),
 w AS (SELECT *, len(regexp_extract_all(s, '[\pL\pM\pN_]+')) >= 3 AS whole FROM s), u AS (SELECT *, least(sum(whole::INT) OVER (PARTITION BY doc_id, ln ORDER BY k) - whole::INT, greatest(sum(whole::INT) OVER (PARTITION BY doc_id, ln) - 1, 0)) AS unit FROM w),
 g AS (SELECT doc_id, ln, unit, min(k) AS k, arg_min(s, k) AS first FROM u GROUP BY ALL) SELECT doc_id, count(*)::INT AS n, md5(string_agg(left(first, 1), '|' ORDER BY ln, k)) AS m FROM g GROUP BY 1""")(
    lambda t: t.documents.select("doc_id", "text", spans.scan_spans("text").alias("s")).where("size(s) > 0").select("doc_id", F.size("s").alias("n"), F.md5(F.array_join(F.transform("s", lambda x: F.substring(F.col("text"), x.start + 1, F.lit(1))), "|")).alias("m")))
query("p1_normal_map")(lambda t: t.documents.select("doc_id", spans.normal_map("text").alias("n")).select("doc_id", F.md5("n.norm").alias("m"), F.size("n.idx").alias("size")))
query("p9_deobfuscated")(lambda t: t.documents.select("doc_id", F.md5(spans.deobfuscated("text")).alias("m")))
query("p10_word_spans", r"SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, '|')) AS m FROM (SELECT doc_id, " + WORDS + " AS w FROM documents)")(
    lambda t: t.documents.select("doc_id", spans.said_words("text").alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s.own", "|")).alias("m")))
query("p13_without_words", "SELECT doc_id, md5(array_to_string(list_filter(w, lambda x, i: i NOT IN (1, 3, 4)), ' ')) AS m FROM (SELECT doc_id, " + WORDS + " AS w FROM documents)")(
    lambda t: t.documents.select("doc_id", F.md5(highlights.without(words(), F.array(F.lit(0), F.lit(2), F.lit(3)))).alias("m")))
query("f2_f3_f4_located")(lambda t: gate.located(gate.check(t.documents, gate.DEFAULT_RULES, surface="source"), gate.DEFAULT_RULES))

# -- media and results -------------------------------------------------------------------------------------------------
query("p48_risk", "SELECT vec_id, round(1 - a, 6) AS safe_softmax, round(greatest(b, c), 6) AS worst, round(least(1, a * 0 + b * 0.5 + c), 6) AS weighted FROM (SELECT vec_id, abs(embedding[1])::DOUBLE AS a, abs(embedding[2])::DOUBLE AS b, abs(embedding[3])::DOUBLE AS c FROM embeddings)")(
    lambda t: t.embeddings.select("vec_id", F.create_map(F.lit("safe"), F.abs(F.col("embedding")[0]).cast("double"), F.lit("review"), F.abs(F.col("embedding")[1]).cast("double"), F.lit("reject"), F.abs(F.col("embedding")[2]).cast("double")).alias("s"))
    .select("vec_id", F.round(media.risk_of(F.col("s"), "safe", "softmax"), 6).alias("safe_softmax"), F.round(media.risk_of(F.col("s"), "safe", "sigmoid"), 6).alias("worst"), F.round(media.risk_of(F.col("s"), "safe", "softmax", {"safe": 0.0, "review": 0.5, "reject": 1.0}), 6).alias("weighted")))
query("p47_softmax", "SELECT vec_id, round(exp(embedding[1]::DOUBLE) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 6) AS p FROM embeddings")(lambda t: t.embeddings.select("vec_id", F.round(media.softmax(F.transform("embedding", lambda x: x.cast("double")))[0], 6).alias("p")))


def _pages(t: Tables) -> DataFrame:
    line = F.struct(F.col("text"), (F.length("text") % 10 / 10.0).alias("score"), F.col("turn"))
    lines = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("x"))
    return lines.select("conv_id", media.page_of(F.transform("x", lambda x: x.l), F.size("x") + F.lit(1)).alias("page"))


query("p49_p50_pages", """SELECT conv_id, md5(string_agg(trim(text), ' ' ORDER BY turn) FILTER (trim(text) <> '')) AS m, round(avg(length(text) % 10 / 10.0), 6) AS confidence,
 length(string_agg(trim(text), ' ' ORDER BY turn) FILTER (trim(text) <> '')) > 0 AND avg(length(text) % 10 / 10.0) >= 0.3 AND (avg(length(text) % 10 / 10.0) >= 0.5 OR length(string_agg(trim(text), ' ' ORDER BY turn) FILTER (trim(text) <> '')) >= 40 * (count(*) + 1)) AS readable FROM conversations GROUP BY 1""")(
    lambda t: _pages(t).select("conv_id", F.md5("page.text").alias("m"), F.round("page.confidence", 6).alias("confidence"), media.readable(F.col("page"), 0.3, 0.5, 40).alias("readable")))
query("x14_media_route", "SELECT event_id, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'image+text' WHEN event_id % 3 = 0 THEN 'image, text unread' ELSE 'image' END WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'text' ELSE 'not checked' END AS way FROM events")(
    lambda t: t.events.select("event_id", media.media_route(F.when(F.col("event_type") == "view", "image").when(F.col("event_type") == "click", "pdf").otherwise("video"), F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("way")))
query("p43_notes", LOG + "SELECT request_id, CASE WHEN decision = 'allow' THEN 'approved' ELSE 'reject' END AS action, CASE WHEN request_id % 3 = 0 THEN 'see ' || modality WHEN decision = 'allow' THEN NULL WHEN request_id % 3 = 1 THEN 'Violation of policy rule: r' || request_id % 7 ELSE 'Content rejected by moderation risk score: ' || (request_id % 10) END AS note FROM log WHERE modality IS NOT NULL")(
    lambda t: t.log.where("modality is not null").select("request_id", media.action_of(F.col("decision")).alias("action"), media.note_of(F.col("decision"), F.when(F.col("request_id") % 3 == 0, F.concat(F.lit("see "), "modality")), F.when(F.col("request_id") % 3 == 1, F.concat(F.lit("r"), F.col("request_id") % 7)), F.col("request_id") % 10).alias("note")))


def _unified(t: Tables) -> DataFrame:
    """The last decision of each member on text and on pictures, as one submission; what is not a picture is text."""
    log = t.log.withColumn("m", F.when(F.col("modality") == "image", "image").otherwise("text"))

    def side(m: str) -> list[F.Column]:
        own = lambda c: F.when(F.col("m") == m, F.col(c) if isinstance(c, str) else c)
        by = F.when(F.col("request_id") % 11 == 0, "disabled").otherwise("model")
        return [F.max_by(own("decision"), own("request_id")).alias(f"{m}_decision"), F.max_by(own(by), own("request_id")).alias(f"{m}_by"), F.max(own("latency_ms")).alias(f"{m}_risk"), F.max(own(F.when(F.col("request_id") % 5 == 0, F.concat(F.lit(f"{m} "), F.col("request_id") % 3)))).alias(f"{m}_note")]

    of = lambda m: {"decision": F.col(f"{m}_decision"), "decided_by": F.col(f"{m}_by"), "risk": F.col(f"{m}_risk"), "note": F.col(f"{m}_note")}
    return log.groupBy("user_id").agg(*side("text"), *side("image")).select("user_id", *[c.alias(n) for n, c in media.unified(of("text"), of("image")).items()])


_SIDE = "arg_max(decision, request_id) FILTER ({1}) AS {0}d, arg_max(CASE WHEN request_id % 11 = 0 THEN 'disabled' ELSE 'model' END, request_id) FILTER ({1}) AS {0}b, max(latency_ms) FILTER ({1}) AS {0}r, max(CASE WHEN request_id % 5 = 0 THEN '{2} ' || request_id % 3 END) FILTER ({1}) AS {0}n"
query("x16_unified", LOG + ", s AS (SELECT user_id, " + _SIDE.format("t", "modality IS DISTINCT FROM 'image'", "text") + ", " + _SIDE.format("i", "modality = 'image'", "image") + """ FROM log GROUP BY 1),
 d AS (SELECT *, CASE WHEN td = 'reject' OR id = 'reject' THEN 'reject' WHEN td = 'revise' OR id = 'revise' THEN 'revise' ELSE 'approved' END AS decision FROM s)
 SELECT user_id, decision, CASE decision WHEN 'approved' THEN 'approved' ELSE 'reject' END AS action, CASE decision WHEN 'approved' THEN 'allow' ELSE decision END AS legacy_decision,
 CASE WHEN tb = 'disabled' OR ib = 'disabled' THEN 'disabled' ELSE coalesce(tb, ib) END AS decided_by, greatest(tr, ir) AS risk,
 nullif(concat_ws(' | ', CASE WHEN td IN ('reject', 'revise') THEN coalesce(tn, 'Text violates moderation policy.') END, CASE WHEN id IN ('reject', 'revise') THEN coalesce("in", 'Image violates moderation policy.') END), '') AS note FROM d""")(_unified)
query("x17_visual_match", """SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'visual.exemplar#' || vec_id WHEN 1 THEN 'visual.exemplar' WHEN 2 THEN 'visual.probe.l' || label ELSE 'visual.l' || label END AS rule_id, CASE WHEN vec_id % 4 > 1 THEN 'c' || label WHEN vec_id % 8 < 4 THEN 'marked' ELSE '' END AS category, 'block' AS action FROM embeddings""")(
    lambda t: t.embeddings.withColumn("k", F.col("vec_id") % 4).select("vec_id", media.visual_match(F.when(F.col("k") < 2, "exemplar").when(F.col("k") == 2, "probe"), F.concat(F.lit("l"), "label"), F.concat(F.lit("c"), "label"), F.when(F.col("k") == 0, F.col("vec_id")), F.when(F.col("vec_id") % 8 < 4, "marked")).alias("m")).select("vec_id", "m.*"))
query("p18_hashtag_text", r"SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w || ' The Day 2024 b'), ' ') AS line FROM part")(
    lambda t: t.part.select("p_partkey", media.hashtag_text(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("#"), w, F.lit("TheDay2024_b"))), ", ,").alias("raw")).alias("line")))
query("p22_first_named", "SELECT event_id, coalesce(nullif(trim(props->>'$.text'), ''), nullif(trim(props->>'$.k'), '')) AS v FROM events")(lambda t: t.events.select("event_id", media.first_named(F.col("props"), ["text", "k"]).alias("v")))
query("p23_attachments", "SELECT conv_id, sum((trim(text) <> '')::INT)::INT + 1 AS n FROM conversations GROUP BY 1")(lambda t: t.conversations.groupBy("conv_id").agg(F.collect_list("text").alias("a")).select("conv_id", media.attachments(F.col("a"), F.array(F.lit("x"), F.lit(" "), F.lit(None).cast("string")), F.lit(None).cast("array<string>")).alias("n")))

# -- pictures ----------------------------------------------------------------------------------------------------------
MARKS = "vec_id % 25 = 0"
NEAR_SQL = UNIT + f", x AS (SELECT vec_id AS ex_id, u AS v, CASE WHEN vec_id % 50 = 0 THEN 'block' ELSE 'allow' END AS action FROM u WHERE {MARKS} AND label <> 3), m AS (SELECT vec_id AS id, label, action, ex_id, list_dot_product(u.u, x.v) AS s FROM u, x), "


def _pictures(t: Tables) -> DataFrame:
    return t.images.select(F.col("vec_id").alias("id"), "u", F.col("label").cast("string").alias("category"))


def _marks(t: Tables) -> DataFrame:
    return t.images.where(MARKS).select(F.col("vec_id").alias("ex_id"), "u", F.when(F.col("vec_id") % 50 == 0, "block").otherwise("allow").alias("action"), F.col("label").cast("string").alias("category"))


def _channels(t: Tables) -> DataFrame:
    near = pictures.near_exemplars(_pictures(t), _marks(t), ("3",)).join(_pictures(t).select("id", "category"), "id")
    return near.withColumn("cause", pictures.channel(F.round("block", 6), F.round("allow", 6), F.col("id") % 10 / 10.0, F.col("id") % 4 == 1, 0.6, 0.05, 0.8, F.col("category") == "3"))


BEST = "b AS (SELECT id, any_value(label) AS label, greatest(coalesce(max(s) FILTER (action = 'block'), 0), 0) AS block, greatest(coalesce(max(s) FILTER (action = 'allow'), 0), 0) AS allow, arg_max(ex_id, (s, -ex_id)) FILTER (action = 'block' AND s > 0) AS matched FROM m GROUP BY 1)"
query("j18_near_exemplars", NEAR_SQL + BEST + " SELECT id, round(block, 5) AS block, round(allow, 5) AS allow, matched FROM b")(
    lambda t: pictures.near_exemplars(_pictures(t), _marks(t), ("3",)).select("id", F.round("block", 5).alias("block"), F.round("allow", 5).alias("allow"), "matched"))
CAUSE = ", c AS (SELECT *, CASE WHEN round(allow, 6) >= 0.6 AND round(allow, 6) >= round(block, 6) THEN NULL WHEN round(block, 6) >= 0.6 AND round(block, 6) - round(allow, 6) >= 0.05 THEN 'exemplar' WHEN label <> 3 AND id % 10 / 10.0 >= 0.8 THEN 'probe' WHEN id % 4 = 1 THEN 'policy' END AS cause FROM b)"
query("x11_x12_f27_channel", NEAR_SQL + BEST + CAUSE + " SELECT id, cause, cause IS NOT NULL AS refused FROM c")(lambda t: _channels(t).select("id", "cause", F.col("cause").isNotNull().alias("refused")))
query("a33_refused_by_channel", NEAR_SQL + BEST + CAUSE + """, f AS (SELECT label, matched, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, matched) AS r FROM c WHERE cause = 'exemplar' GROUP BY 1, 2), t AS (SELECT label, string_agg(matched::VARCHAR, ',' ORDER BY r) AS marks FROM f WHERE r <= 4 GROUP BY 1)
 SELECT c.label::VARCHAR AS "set", cause, count(*) AS n, coalesce(any_value(marks), '') AS marks FROM c LEFT JOIN t USING (label) WHERE cause IS NOT NULL GROUP BY 1, 2""")(lambda t: pictures.by_channel(_channels(t).withColumnRenamed("category", "set")))
query("j17_j28_reach", UNIT + ", x AS (SELECT * FROM u WHERE vec_id % 100 = 0), o AS (SELECT u.vec_id, any_value(u.label) AS label, max(list_dot_product(u.u, x.u)) AS s FROM u, x WHERE u.vec_id % 100 <> 0 GROUP BY 1) SELECT label::VARCHAR AS category, count(*) AS n FROM o WHERE s >= 0.5 GROUP BY 1")(
    lambda t: pictures.reach(_pictures(t), _marks(t).where("ex_id % 100 = 0"), 0.5))
query("w15_most_alike", NEAR_SQL + BEST + " SELECT id, round(block, 5) AS block FROM b WHERE id % 25 <> 0 ORDER BY b.block DESC, id LIMIT 12")(
    lambda t: pictures.most_alike(pictures.near_exemplars(_pictures(t), _marks(t), ("3",)).where("id % 25 <> 0"), 12).select("id", F.round("block", 5).alias("block")))
IMAGES = "WITH i AS (SELECT p_partkey AS id, p_brand AS category, p_name AS filename, p_type AS description, CASE WHEN p_size % 2 = 0 THEN 'allow' ELSE 'block' END AS action, (p_size > 25)::INT AS is_selected FROM part) "
_images = lambda t: t.part.select(F.col("p_partkey").alias("id"), F.lower("p_brand").alias("category"), F.col("p_name").alias("filename"), F.col("p_type").alias("description"), F.when(F.col("p_size") % 2 == 0, "allow").otherwise("block").alias("action"), (F.col("p_size") > 25).cast("int").alias("is_selected"))
query("f10_image_list", IMAGES + "SELECT id FROM i WHERE action = 'allow' AND is_selected = 1 AND (filename ILIKE '%re%' OR description ILIKE '%re%')")(lambda t: _images(t).where(pictures.where_images("all", "Allow", 1, " re ")).select("id"))
query("a9_filtered_stats", IMAGES + "SELECT count(*) AS total, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (is_selected = 1) AS selected, count(*) FILTER (is_selected = 1 AND action = 'allow') AS teaching_allow, count(*) FILTER (is_selected = 1 AND action = 'block') AS teaching_block FROM i WHERE filename ILIKE '%a%' OR description ILIKE '%a%'")(
    lambda t: pictures.list_stats(_images(t).where(pictures.where_images(search="a"))))
query("z22_label_bars", "WITH s AS (SELECT vec_id AS id, unnest(['a', 'b', 'c']) AS label, unnest([abs(embedding[1]), abs(embedding[2]), abs(embedding[3])])::DOUBLE AS score FROM embeddings) SELECT id, label, CASE label WHEN 'a' THEN 0.1 WHEN 'b' THEN 0.2 ELSE 0.15 END::DOUBLE AS bar, score >= CASE label WHEN 'a' THEN 0.1 WHEN 'b' THEN 0.2 ELSE 0.15 END AS over FROM s")(
    lambda t: pictures.label_bars(t.embeddings.select(F.col("vec_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.abs(F.col("embedding")[k]).cast("double").alias("score")) for k, n in enumerate("abc")])).alias("x")).select("id", "x.*"), t.spark.createDataFrame([("a", 0.1), ("b", 0.2)], "label string, bar double"), 0.15).select("id", "label", "bar", "over"))
query("p46_cluster_of", r"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR ELSE replace(p_name, ' ', '_') || '_' END AS cluster FROM part")(
    lambda t: t.part.select("p_partkey", pictures.cluster_of(F.concat(F.lit("a/b.c/"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.translate("p_name", " ", "_"), F.lit("_00"), "p_size")), F.lit(".jpg"))).alias("cluster")))

# -- training rows -----------------------------------------------------------------------------------------------------
_rows = lambda t: t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("toxic").alias("label"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("category"))
query("f22_mentions", r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') AS has FROM documents")(lambda t: t.documents.select("doc_id", training.mentions(F.col("text"), "the").alias("has")))
query("t6_swapped_copies")(lambda t: training.swapped_copies(_rows(t), "the", ("of", "and"), 0.5).select("id", "label", F.md5("text").alias("m")))
query("t7_upload", "WITH r AS (SELECT doc_id AS id, trim(text) AS text, CASE WHEN doc_id % 2 = 0 THEN source END AS category FROM documents JOIN labels USING (doc_id)), f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS k FROM r WHERE text <> '') SELECT id, coalesce(category, 'new') AS category, CASE WHEN id % 10 = 0 THEN 'test' WHEN id % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM f WHERE k = 1")(
    lambda t: training.upload(_rows(t), F.expr(SPLIT.replace("doc_id", "id")), "new").select("id", "category", "split"))
HELD = f"(SELECT {SQL_KEY} AS k FROM documents WHERE doc_id % 10 = 0)"
query("t8_z32_leaks", f"SELECT count(*) AS n FROM documents WHERE doc_id % 10 <> 0 AND {SQL_KEY} IN {HELD}")(lambda t: training.leaks(t.documents.where("doc_id % 10 <> 0"), t.documents.where("doc_id % 10 = 0"), lambda c: F.md5(T.norm_key(c))).agg(F.count("*").alias("n")))
query("j2_unseen", f"SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND {SQL_KEY} NOT IN {HELD}")(lambda t: training.unseen(t.documents.where("doc_id % 10 <> 0"), t.documents.where("doc_id % 10 = 0"), lambda c: F.md5(T.norm_key(c))).select("doc_id"))
query("f16_safe_enough", f"SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND length(text) >= 200 AND source <> 'src3' AND {SQL_KEY} NOT IN {HELD}")(lambda t: training.safe_enough(t.documents.where("doc_id % 10 <> 0"), t.documents.where("doc_id % 10 = 0"), F.col("source") == "src3", lambda c: F.md5(T.norm_key(c)), 200).select("doc_id"))
query("j29_still_there", "SELECT count(*) AS missing FROM (SELECT p_brand FROM part EXCEPT ALL SELECT p_brand FROM part WHERE p_size > 5)")(lambda t: training.still_there(t.part, t.part.where("p_size > 5"), "p_brand"))
query("a39_span_labels", "SELECT md5(span) AS m, max(toxic) AS label FROM (SELECT unnest(string_split(text, chr(10))) AS span, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY 1")(lambda t: training.span_labels(_rows(t).select(F.explode(F.split("text", "\n")).alias("span"), "label")).select(F.md5("span").alias("m"), "label"))
query("w18_head_and_window")(lambda t: t.documents.select("doc_id", F.md5(training.head_and_window(words(), 12, F.col("doc_id"))).alias("m")))
query("z5_reconciled", "SELECT item_id AS id, length(text) % 2 AS label, length(text) % 2 AS public_label FROM benchmark UNION ALL SELECT doc_id, toxic, quality FROM labels")(
    lambda t: training.reconciled([t.benchmark.select(F.col("item_id").alias("id"), (F.length("text") % 2).alias("label")), t.labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"), F.col("quality").alias("public_label"))]))

# -- highlights --------------------------------------------------------------------------------------------------------
SPANS = "WITH s AS (SELECT conv_id AS doc_id, turn AS k, turn * 100 AS start, turn * 100 + length(text) AS end_, length(text) % 10 / 10.0 AS risk, turn % 3 = 0 AS low, turn % 4 = 0 AS pre FROM conversations) "
_scored = lambda t: t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("k"), (F.col("turn") * 100).alias("start"), (F.col("turn") * 100 + F.length("text")).alias("end"), (F.length("text") % 10 / 10.0).alias("risk"), (F.col("turn") % 3 == 0).alias("low_syntax"), (F.col("turn") % 4 == 0).alias("prefilter"))
query("f18_rejecting", SPANS + "SELECT doc_id, k FROM s WHERE NOT pre AND risk >= 0.5 AND (NOT low OR risk >= 0.8)")(lambda t: highlights.rejecting(_scored(t), 0.5, 0.8).select("doc_id", "k"))
query("x8_shown", SPANS + ", h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM s), g AS (SELECT *, bool_or(risk > 0.6) OVER (PARTITION BY doc_id) AS any_over, row_number() OVER (PARTITION BY doc_id ORDER BY risk DESC, k) AS best FROM h WHERE r <= 3) SELECT doc_id, k FROM g WHERE risk > 0.6 OR (NOT any_over AND doc_id % 2 <> 0 AND best = 1)")(
    lambda t: highlights.shown(_scored(t), 0.6, 3, F.col("doc_id") % 2 == 0).select("doc_id", "k"))
query("w7_riskiest_window", SPANS + "SELECT doc_id, k // 3 AS span, arg_max(k, (risk, -k)) AS k, max(risk)::DOUBLE AS risk FROM s GROUP BY 1, 2")(lambda t: highlights.riskiest(_scored(t).withColumn("span", F.floor(F.col("k") / 3))))
query("j24_not_touching", SPANS + "SELECT doc_id, k FROM s WHERE k % 2 = 1 AND NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.k % 2 = 0 AND o.start < s.end_ AND s.start < o.end_)")(lambda t: highlights.not_touching(_scored(t).where("k % 2 = 1"), _scored(t).where("k % 2 = 0")).select("doc_id", "k"))
query("p24_in_fields", SPANS + ", f AS (SELECT conv_id AS doc_id, unnest(['title', 'body']) AS field, unnest([0, 150]) AS a, unnest([148, 100000]) AS b FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT doc_id, field, greatest(start, a) - a AS start, least(end_, b) - a AS \"end\" FROM s JOIN f USING (doc_id) WHERE start < b AND a < end_")(
    lambda t: highlights.in_fields(_scored(t), t.conversations.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.lit(0).alias("from"), F.lit(148).alias("to")), F.struct(F.lit("body").alias("field"), F.lit(150).alias("from"), F.lit(100000).alias("to")))).alias("f")).select("doc_id", "f.*")))
query("w14_in_order", SPANS + "SELECT doc_id, string_agg(k::VARCHAR, ',' ORDER BY risk, end_) AS ks FROM s GROUP BY 1")(
    lambda t: _scored(t).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("risk").alias("start"), "end", "k")).alias("i")).select("doc_id", F.array_join(F.transform(highlights.in_order(F.col("i")), lambda x: x.k.cast("string")), ",").alias("ks")))

# -- blocklist ---------------------------------------------------------------------------------------------------------
ENTRIES = """, e AS (SELECT 'member' AS scope, s_suppkey::VARCHAR AS value, min('m' || s_nationkey) AS reason FROM supplier WHERE s_acctbal < 0 GROUP BY 2 UNION ALL SELECT 'ip', '10.0.1.' || n_nationkey, 'n' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'network', '10.0.' || r_regionkey || '.0/24', r_name FROM region WHERE r_regionkey > 2),
 c AS (SELECT request_id, user_id, '10.0.' || request_id % 5 || '.' || request_id % 50 AS ip, '10.0.' || request_id % 5 || '.0/24' AS network FROM log) """


def _entries(t: Tables) -> DataFrame:
    at = F.lit(1.0).alias("created_at")
    rows = t.supplier.where("s_acctbal < 0").select(F.lit("member").alias("scope"), F.col("s_suppkey").cast("string").alias("value"), F.concat(F.lit("m"), "s_nationkey").alias("reason"), at)
    rows = rows.unionByName(t.nation.where("n_nationkey % 2 = 0").select(F.lit("ip").alias("scope"), F.concat(F.lit("10.0.1."), "n_nationkey").alias("value"), F.lit("n").alias("reason"), at))
    return rows.unionByName(t.region.where("r_regionkey > 2").select(F.lit("network").alias("scope"), F.concat(F.lit("10.0."), "r_regionkey", F.lit(".0/24")).alias("value"), F.col("r_name").alias("reason"), at))


def _probed(t: Tables) -> DataFrame:
    calls = t.log.select("request_id", "user_id", F.concat(F.lit("10.0."), F.col("request_id") % 5, F.lit("."), F.col("request_id") % 50).alias("ip"))
    return blocklist.probed(calls.withColumn("network", T.network_of(F.col("ip"))), _entries(t))


PROBE = LOG + ENTRIES + ", p AS (SELECT c.*, m.reason AS rm, i.reason AS ri, n.reason AS rn FROM c LEFT JOIN e m ON m.scope = 'member' AND m.value = c.user_id::VARCHAR LEFT JOIN e i ON i.scope = 'ip' AND i.value = c.ip LEFT JOIN e n ON n.scope = 'network' AND n.value = c.network) "
query("f14_blocklist_probe", PROBE + "SELECT request_id, CASE WHEN rm IS NOT NULL THEN 'member' WHEN ri IS NOT NULL THEN 'ip' WHEN rn IS NOT NULL THEN 'network' END AS scope, coalesce(rm, ri, rn) AS reason FROM p")(
    lambda t: _probed(t).select("request_id", F.col("blocked_scope").alias("scope"), F.col("blocked_reason").alias("reason")))
query("r8_refused_callers", PROBE + "SELECT count(*) AS n, count(coalesce(rm, ri, rn)) AS refused FROM p")(lambda t: _probed(t).agg(F.count("*").alias("n"), F.count("blocked_scope").alias("refused")))
query("j15_blocked_flags", LOG + ENTRIES + "SELECT user_id, count(*) AS n, user_id::VARCHAR IN (SELECT value FROM e WHERE scope = 'member') AS blocked FROM log WHERE user_id IS NOT NULL GROUP BY 1")(lambda t: blocklist.flagged(t.log.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n")), _entries(t)))
query("c7_blocklist_upserts", """WITH old AS (SELECT s_suppkey::VARCHAR AS value, 'old' AS reason FROM supplier WHERE s_acctbal < 2000), new AS (SELECT c_custkey::VARCHAR AS value, c_acctbal > 0 AS blocked, 'new' || c_nationkey AS reason FROM customer WHERE c_custkey % 2 = 0)
 SELECT 'member' AS scope, coalesce(new.value, old.value) AS value, coalesce(new.reason, old.reason) AS reason FROM old FULL JOIN new USING (value) WHERE coalesce(blocked, true)""")(
    lambda t: blocklist.upserted(t.supplier.where("s_acctbal < 2000").select(F.lit("member").alias("scope"), F.col("s_suppkey").cast("string").alias("value"), F.lit("old").alias("reason"), F.lit(1.0).alias("created_at")), t.customer.where("c_custkey % 2 = 0").select(F.lit("member").alias("scope"), F.col("c_custkey").cast("string").alias("value"), F.concat(F.lit("new"), "c_nationkey").alias("reason"), F.lit(2.0).alias("created_at"), (F.col("c_acctbal") > 0).alias("blocked"))).select("scope", "value", "reason"))


# -- word analysis -----------------------------------------------------------------------------------------------------
def _occlusion(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Sentences that the stand-in model would refuse, their words shortlisted by length as the stand-in pre-filter."""
    issues = t.documents.select("doc_id", F.explode_outer(spans.said_sentences("text")).alias("s")).where("s is not null").select("doc_id", "s.start", "s.end", T.code_sum_score(F.col("s.own")).alias("risk")).where("risk >= 0.7")
    return occlusion.analyse_words(t.spark, t.documents.select("doc_id", "text"), issues, T.code_sum_score, 0.3, lambda c: F.length(c) % 100 / F.lit(100))


query("m13_w8_word_contributions")(lambda t: _occlusion(t)[0])
query("m13_w10_trigger_words")(lambda t: _occlusion(t)[1].select("doc_id", "start", "end", F.array_join(F.transform("triggers", lambda w: F.concat_ws(":", w["start"].cast("string"), w["end"].cast("string"))), ",").alias("triggers")))


# -- policies over time ------------------------------------------------------------------------------------------------
def _policy_changes(t: Tables) -> DataFrame:
    """Sign-ups as changes of the policy of one of seven surfaces: a level, a switch, or both."""
    rows = t.events.where("event_type = 'signup'").withColumn("k", F.col("event_id") % 5)
    level = F.when(F.col("k") == 0, "strict").when(F.col("k") == 1, "open").when(F.col("k") == 2, "medium")
    return rows.select(F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("surface"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("k") > 2, F.col("k") == 4).alias("enabled"), level.alias("level"), F.lit(None).cast("double").alias("allow_max"), F.lit(None).cast("double").alias("reject_min"))


_LEVELS = {"strict": (0.1, 0.1), "medium": (0.3, 0.7), "open": (0.9, 0.95)}
query("r9_c10_policy_as_of", """WITH c AS (SELECT 's' || (user_id % 7) AS surface, ts::TIMESTAMP AS since, event_id AS seq, CASE WHEN event_id % 5 > 2 THEN event_id % 5 = 4 END AS enabled, CASE event_id % 5 WHEN 0 THEN 'strict' WHEN 1 THEN 'open' WHEN 2 THEN 'medium' END AS level FROM events WHERE event_type = 'signup'),
 f AS (SELECT surface, since, seq, coalesce(last_value(enabled IGNORE NULLS) OVER w, true) AS enabled, last_value(level IGNORE NULLS) OVER w AS level FROM c WINDOW w AS (PARTITION BY surface ORDER BY since, seq ROWS UNBOUNDED PRECEDING)),
 v AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY surface, since ORDER BY seq DESC) = 1),
 e AS (SELECT event_id, 's' || (user_id % 7) AS surface, ts::TIMESTAMP AS ts FROM events)
 SELECT e.event_id, v.enabled, v.level, CASE v.level WHEN 'strict' THEN 0.1 WHEN 'medium' THEN 0.3 WHEN 'open' THEN 0.9 END::DOUBLE AS allow_max, CASE v.level WHEN 'strict' THEN 0.1 WHEN 'medium' THEN 0.7 WHEN 'open' THEN 0.95 END::DOUBLE AS reject_min
 FROM e ASOF LEFT JOIN v ON e.surface = v.surface AND e.ts >= v.since""")(
    lambda t: policy.as_of(t.events.select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("surface"), F.col("ts").cast("timestamp").alias("ts")), policy.policy_versions(_policy_changes(t), _LEVELS)).select("event_id", "enabled", "level", "allow_max", "reject_min"))
query("p53_p54_noise")(lambda t: t.documents.select("doc_id", F.md5(noise.noise(F.col("text"), noise.Draws(F.col("doc_id")))).alias("noise"), F.md5(noise.obfuscate(F.col("text"), noise.Draws(F.col("doc_id")))).alias("obfuscated")))
