"""Queries of the report operators, with SQL; importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decision, reports, vision
from .queries import LOG, SCORED, Tables, query

GRID = [round(i / 20, 2) for i in range(21)]
STEPS = "(SELECT unnest([" + ",".join(map(str, GRID)) + "]) AS threshold)"
SQL_KEY = r"md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"
SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END"


def _split(t: Tables) -> DataFrame:
    return t.documents.withColumn("split", F.expr(SPLIT))


def _decided(t: Tables) -> DataFrame:
    return t.scored.withColumn("decision", decision.name_of(decision.route(F.col("p"), F.lit(0.3), F.lit(0.7))))


DECIDED = SCORED + ", decided AS (SELECT *, CASE WHEN p <= 0.3 THEN 'allow' WHEN p >= 0.7 THEN 'reject' ELSE 'revise' END AS decision FROM scored) "

query("a37_z16_latency_places", LOG + """, v AS (SELECT decision, latency_ms, row_number() OVER (PARTITION BY decision ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY decision) AS n FROM log WHERE latency_ms IS NOT NULL)
 SELECT decision, n, max(latency_ms) FILTER (i = round_even(0.5*(n-1), 0)) AS p50, max(latency_ms) FILTER (i = round_even(0.95*(n-1), 0)) AS p95, max(latency_ms) FILTER (i = round_even(0.95*(n-1), 0)) <= 90 AS in_budget FROM v GROUP BY 1,2""")(
    lambda t: reports.places(t.log, "decision", "latency_ms", [50, 95]).withColumn("in_budget", F.col("p95") <= 90))
query("a32_threshold_by_set", SCORED + f""", g AS (SELECT source, threshold, coalesce(count(*) FILTER (y=1 AND p>=threshold)/nullif(count(*) FILTER (y=1),0),0) AS recall, coalesce(count(*) FILTER (y=0 AND p>=threshold)/nullif(count(*) FILTER (y=0),0),0) AS fpr FROM scored, {STEPS} GROUP BY 1,2)
 SELECT source, threshold, round(recall,6) AS recall, round(fpr,6) AS fpr FROM g""")(lambda t: reports.grid_by(t.scored, "source", GRID))
query("a32_a35_best_threshold", SCORED + f""", g AS (SELECT source, threshold, round(coalesce(count(*) FILTER (y=1 AND p>=threshold)/nullif(count(*) FILTER (y=1),0),0),6) AS recall, round(coalesce(count(*) FILTER (y=0 AND p>=threshold)/nullif(count(*) FILTER (y=0),0),0),6) AS fpr FROM scored, {STEPS} GROUP BY 1,2),
 w AS (SELECT threshold, min(recall) AS recall, max(fpr) AS fpr FROM g GROUP BY 1) SELECT threshold, recall FROM w WHERE fpr <= 0.5 ORDER BY recall DESC, threshold LIMIT 1""")(lambda t: reports.best_threshold(reports.grid_by(t.scored, "source", GRID), 0.5))
query("a34_agreement", SCORED + """SELECT source, count(*) FILTER (p>=0.5 AND quality=0) AS both, count(*) FILTER (p>=0.5 AND quality=1) AS ours, count(*) FILTER (p<0.5 AND quality=0) AS theirs, count(*) FILTER (p<0.5 AND quality=1) AS neither FROM scored GROUP BY 1""")(
    lambda t: reports.agreement(t.scored, 0.5, F.col("quality") == 0, "source"))
query("a44_z11_head_metrics", SCORED + """, m AS (SELECT *, least(greatest(p,1e-7),1-1e-7) AS q FROM scored WHERE quality = 1) SELECT count(*) AS n, round(avg(((p>=0.5)=(y=1))::INT),6) AS accuracy, round(count(*) FILTER (p>=0.5 AND y=1)/count(*) FILTER (y=1),6) AS recall,
 round(count(*) FILTER (p>=0.5 AND y=0)/count(*) FILTER (y=0),6) AS fpr, round(avg(CASE WHEN y=1 THEN -ln(q) ELSE -ln(1-q) END),6) AS log_loss FROM m""")(lambda t: reports.head_metrics(t.scored, F.col("quality") == 1))
query("a46_z15_moved", SCORED + """, d AS (SELECT y, CASE WHEN p<=0.3 THEN 0 WHEN p>=0.7 THEN 2 ELSE 1 END AS a, CASE WHEN p<=0.4 THEN 0 WHEN p>=0.6 THEN 2 ELSE 1 END AS b FROM scored) SELECT count(*) FILTER (a<>b) AS moved, count(*) FILTER ((y=1 AND b<a) OR (y=0 AND b>a)) AS harmful FROM d""")(
    lambda t: reports.moved(t.scored, F.expr("case when p<=0.3 then 0 when p>=0.7 then 2 else 1 end"), F.expr("case when p<=0.4 then 0 when p>=0.6 then 2 else 1 end")))
query("a23_label_conflicts", f"SELECT {SQL_KEY} AS key, CASE WHEN min(toxic)=max(toxic) THEN min(toxic) END AS label, coalesce(min(toxic)<>max(toxic), false) AS conflict FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")(
    lambda t: reports.label_conflicts(t.documents.join(t.labels, "doc_id", "left"), F.md5(T.norm_key(F.col("text"))), "toxic"))
query("a24_strictest_split", f"""WITH s AS (SELECT doc_id, {SQL_KEY} AS key, {SPLIT} AS split FROM documents) SELECT doc_id, split, CASE max(CASE split WHEN 'test' THEN 2 WHEN 'val' THEN 1 ELSE 0 END) OVER (PARTITION BY key) WHEN 2 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS strict FROM s""")(
    lambda t: reports.strictest_split(_split(t), F.md5(T.norm_key(F.col("text"))), "split").select("doc_id", "split", "strict"))
query("a25_moved_splits", f"""WITH s AS (SELECT {SQL_KEY} AS key, {SPLIT} AS split FROM documents), m AS (SELECT split, CASE max(CASE split WHEN 'test' THEN 2 WHEN 'val' THEN 1 ELSE 0 END) OVER (PARTITION BY key) WHEN 2 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS strict FROM s) SELECT split, strict, count(*) AS n FROM m WHERE split<>strict GROUP BY 1,2""")(
    lambda t: reports.strictest_split(_split(t), F.md5(T.norm_key(F.col("text"))), "split").where("split <> strict").groupBy("split", "strict").agg(F.count("*").alias("n")))
query("a11_refusal_report", DECIDED + """, c AS (SELECT source, lang, count(*) AS n FROM decided WHERE decision='reject' GROUP BY 1,2), e AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM decided WHERE decision='reject')
 SELECT source, count(*) AS n, count(*) FILTER (decision='reject') AS refused, round(100.0*count(*) FILTER (decision='reject')/count(*),6) AS pct, (SELECT string_agg(lang||'='||n, ',' ORDER BY lang) FROM c WHERE c.source=decided.source) AS by_cause, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM e WHERE e.source=decided.source AND r<=5) AS examples FROM decided GROUP BY 1""")(
    lambda t: reports.refusal_report(_decided(t), "source", F.col("decision") == "reject", F.col("lang"), "doc_id").withColumns({"by_cause": F.array_join(F.transform(F.map_entries("by_cause"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","), "examples": F.array_join(F.transform("examples", lambda x: x.cast("string")), ",")}))
query("z1_leak_premium", DECIDED + """, l AS (SELECT source, ((p>=0.5)=(y=1)) AS ok, doc_id % 7 = 0 AS leaked FROM decided), g AS (SELECT source, count(*) FILTER (leaked) AS n_leaked, count(*) FILTER (NOT leaked) AS n_clean, avg(ok::INT) FILTER (leaked) AS a, avg(ok::INT) FILTER (NOT leaked) AS b FROM l GROUP BY 1)
 SELECT source, n_leaked, n_clean, round(a,6) AS leaked, round(b,6) AS clean, round((a-b)*100,4) AS premium FROM g""")(lambda t: reports.leak_premium(_decided(t), (F.col("p") >= 0.5) == (F.col("y") == 1), F.col("doc_id") % 7 == 0, "source"))
SETS = DECIDED + """, z AS (SELECT source, count(*) AS n, coalesce(count(*) FILTER (y=0 AND decision='allow')/nullif(count(*) FILTER (y=0),0),1) AS allowed, coalesce(count(*) FILTER (y=1 AND decision<>'allow')/nullif(count(*) FILTER (y=1),0),1) AS caught,
 count(*) FILTER ((y=0)=(decision='allow'))/count(*) AS accuracy FROM decided GROUP BY 1) SELECT source, n, round(allowed,6) AS allowed, round(caught,6) AS caught, round(accuracy,6) AS accuracy FROM z"""
query("a19_z2_z6_set_scores", SETS)(lambda t: reports.set_scores(_decided(t), "decision", "source"))
query("z12_weak_sets", SETS + " WHERE round(caught,6) < 0.7")(lambda t: reports.weak(reports.set_scores(_decided(t), "decision", "source"), 0.7))
query("p55_sigma_level")(lambda t: _decided(t).groupBy("source").agg(F.avg(((F.col("decision") == "allow") != (F.col("y") == 0)).cast("double")).alias("rate")).select("source", reports.sigma_level("rate").alias("sigma")))
query("t4_rehearsal", DECIDED + f"SELECT doc_id FROM decided WHERE {SPLIT} <> 'train' OR CASE y WHEN 0 THEN ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT < 0.2 * 4294967296 ELSE ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT < 0.5 * 4294967296 END")(
    lambda t: reports.rehearsal(_decided(t), F.col("doc_id"), {"0": 0.2, "1": 0.5}, F.col("y").cast("string"), F.expr(SPLIT)).select("doc_id"))
query("t5_thinned_unsafe", SCORED + f"SELECT doc_id FROM scored WHERE NOT ({SPLIT} = 'train' AND y = 1 AND quality = 1) OR ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT < 0.4 * 4294967296")(
    lambda t: t.scored.where(~((F.expr(SPLIT) == "train") & (F.col("y") == 1) & (F.col("quality") == 1)) | reports.in_share(F.col("doc_id"), 0.4)).select("doc_id"))
query("t2_a42_a43_relabel", r"""SELECT CASE WHEN regexp_matches(lower(text), '\b(idiots?|scums?|morons?)\b') THEN 'insult' WHEN toxic = 1 THEN 'other_unsafe' ELSE 'safe' END AS category, count(*) AS n, sum(toxic)::BIGINT AS unsafe FROM documents JOIN labels USING (doc_id) GROUP BY 1""")(
    lambda t: t.documents.join(t.labels, "doc_id").groupBy(F.when(F.lower("text").rlike(r"\b(idiots?|scums?|morons?)\b"), "insult").when(F.col("toxic") == 1, "other_unsafe").otherwise("safe").alias("category")).agg(F.count("*").alias("n"), F.sum("toxic").alias("unsafe")))
query("u1_u2_corpus_union", "SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT source FROM documents WHERE source = 'src3' UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY 1")(
    lambda t: t.documents.select("source").unionByName(t.documents.where("source = 'src3'").select("source")).unionByName(t.benchmark.select(F.lit("benchmark").alias("source"))).groupBy("source").agg(F.count("*").alias("n")))
query("u6_key_union", "SELECT user_id AS k FROM events UNION SELECT c_custkey FROM customer")(lambda t: t.events.select(F.col("user_id").alias("k")).union(t.customer.select("c_custkey")).distinct())
query("f12_x6_prefilter", SCORED + """SELECT CASE WHEN greatest(p, p * 0.5 + 0.01) < 0.2 THEN 'cleared' ELSE 'scored' END AS way, count(*) AS n, count(*) FILTER (y = 1) AS unsafe FROM scored GROUP BY 1""")(
    lambda t: t.scored.groupBy(F.when(F.greatest("p", F.col("p") * 0.5 + 0.01) < 0.2, "cleared").otherwise("scored").alias("way")).agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("unsafe")))
query("f17_min_length", "SELECT conv_id, turn FROM conversations WHERE length(trim(text)) >= 25")(lambda t: t.conversations.where(F.length(F.trim("text")) >= 25).select("conv_id", "turn"))
query("p36_clean_entry", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '2001:db8::' || c_nationkey ELSE '10.1.2.' || c_nationkey END AS entry FROM customer")(
    lambda t: t.customer.select("c_custkey", T.clean_entry(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("[2001:db8::"), "c_nationkey", F.lit("]:443"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" 10.1.2."), "c_nationkey", F.lit(":51324 "))).otherwise(F.concat(F.lit("10.1.2."), "c_nationkey"))).alias("entry")))

@query("p44_near_categories", r"""WITH k AS (SELECT DISTINCT p_type AS c FROM part UNION SELECT DISTINCT replace(lower(p_type), ' ', '_') || 's' FROM part), n AS (SELECT c, regexp_replace(lower(c), '[^a-z0-9]+', '', 'g') AS r FROM k),
 q AS (SELECT c, CASE WHEN r LIKE '%ies' THEN left(r, length(r)-3) || 'y' WHEN r LIKE '%s' AND r NOT LIKE '%ss' THEN left(r, length(r)-1) ELSE r END AS key FROM n) SELECT a.c AS category, b.c AS near FROM q a JOIN q b ON a.key = b.key AND a.c <> b.c""")
def _near(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_type").alias("c")).union(t.part.select(F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("s")))).distinct().withColumn("key", T.category_key(F.col("c")))
    return names.alias("a").join(names.alias("b"), "key").where("a.c <> b.c").select(F.col("a.c").alias("category"), F.col("b.c").alias("near"))


query("p45_sensitive", "SELECT page_id, regexp_matches(lower(coalesce(url,'')), 'sexual|nudity|nude|porn|nsfw|erotic|explicit_adult') AS flagged FROM pages")(
    lambda t: t.pages.select("page_id", T.sensitive(F.lit(None).cast("string"), F.lit(""), F.col("url"), F.lit(None).cast("string")).alias("flagged")))

@query("p10_p12_word_variants", r"""SELECT p_partkey, i::INT AS i, CASE WHEN i = 1 THEN '' ELSE array_to_string(w[:i-1], ' ') END || CASE WHEN i < len(w) THEN ' ' || array_to_string(w[i+1:], ' ') ELSE '' END AS variant FROM (SELECT p_partkey, w, unnest(range(1, len(w)+1)) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))""")
def _variants(t: Tables) -> DataFrame:
    w = F.split("p_name", " ")
    at = t.part.select("p_partkey", "p_name", F.posexplode(w).alias("i", "word"), w.alias("w")).withColumn("start", F.length(F.array_join(F.slice("w", F.lit(1), F.col("i")), " ")) + F.when(F.col("i") > 0, 1).otherwise(0))
    return at.select("p_partkey", (F.col("i") + 1).alias("i"), T.drop_word(F.col("p_name"), F.col("start"), F.col("start") + F.length("word")).alias("variant"))


query("p60_user_of", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE left('user-' || user_id, 6) END AS u FROM events")(
    lambda t: t.events.select("event_id", T.user_of(F.when(F.col("event_id") % 3 == 1, F.concat(F.lit(" user-"), "user_id")), F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("user-"), "user_id")).otherwise("  "), size=6).alias("u")))
query("w9_triggers", """WITH g AS (SELECT p_partkey, i, word, (unicode(word) + i * 7) % 20 / 100.0 AS gain FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part))
 SELECT p_partkey, i::INT AS i, word, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY gain DESC, i) AS r FROM g WHERE gain >= 0.05) WHERE r <= 2""")(
    lambda t: reports.triggers(t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word")).withColumn("i", F.col("i") + 1), "p_partkey", "i", (F.ascii("word") + F.col("i") * 7) % 20 / 100, 0.05, 2).select("p_partkey", "i", "word", F.round("gain", 6).alias("gain")))
query("w5_latest_run", LOG + "SELECT decision, max(request_id) AS request_id, arg_max(latency_ms, request_id) AS latency_ms FROM log WHERE latency_ms IS NOT NULL GROUP BY 1")(
    lambda t: t.log.where("latency_ms is not null").groupBy("decision").agg(F.max("request_id").alias("request_id"), F.max_by("latency_ms", "request_id").alias("latency_ms")))
query("r6_rate_limit")(lambda t: reports.rate_limited(t.log.select("user_id", "request_id", "created_at"), "user_id", "created_at", "request_id", 3, 86400.0))
