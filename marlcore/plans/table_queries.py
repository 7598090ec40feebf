"""Text, log, sample and relational queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import strings as X
from ..operators import tables as T, text as TX
from .registry import query, r

TERMS = "w AS (SELECT {id} AS id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM {table}), {name} AS (SELECT id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL)"
TFIDF = "WITH " + TERMS.format(id="doc_id", table="documents", name="c") + ", df AS (SELECT term, count(*) AS df, sum(tf) AS n FROM c GROUP BY term ORDER BY n DESC, term LIMIT 1000), i AS (SELECT term, df, CAST(n AS BIGINT) AS n, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1 AS idf FROM df)"


@query(TFIDF + " SELECT term, df, n, round(idf, 6) AS idf FROM i ORDER BY i.n DESC, term LIMIT 100")
def tfidf_top_terms(t):
    counts = TX.term_counts(t.documents, "doc_id", "text")
    return TX.idf(counts, t.documents.count(), 1000).orderBy(F.desc("n"), "term").limit(100).select("term", "df", "n", r("idf").alias("idf"))


@query(
    TFIDF
    + """, v AS (SELECT c.id, term, tf * idf AS w FROM c JOIN i USING (term)), nv AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM v),
    """
    + TERMS.format(id="item_id", table="benchmark", name="bc").replace("w AS (", "bw AS (", 1).replace("FROM w WHERE", "FROM bw WHERE")
    + """, b AS (SELECT bc.id, term, tf * idf AS w FROM bc JOIN i USING (term)), nb AS (SELECT id AS query, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS wq FROM b),
    s AS (SELECT query, id, round(sum(w * wq), 9) AS cosine FROM nv JOIN nb USING (term) GROUP BY ALL)
    SELECT query, id, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM s) WHERE rank <= 3"""
)
def tfidf_cosine_top3(t):
    counts = TX.term_counts(t.documents, "doc_id", "text")
    weights = TX.idf(counts, t.documents.count(), 1000)
    found = TX.cosine_top(TX.tfidf(TX.term_counts(t.benchmark, "item_id", "text"), weights), TX.tfidf(counts, weights), 3)
    return found.select("query", "id", r("cosine").alias("cosine"), "rank")


@query("SELECT doc_id, CAST(s // 600 AS INTEGER) AS chunk_no, length(substring(text, s + 1, 800)) AS n, md5(substring(text, s + 1, 800)) AS digest FROM (SELECT doc_id, text, CAST(unnest(range(0, length(text), 600)) AS INTEGER) AS s FROM documents)")
def doc_chunks(t):
    x = t.documents.select("doc_id", F.explode(X.chunks("text")).alias("c"))
    return x.select("doc_id", F.col("c.chunk_no").alias("chunk_no"), F.length("c.chunk").cast("bigint").alias("n"), F.md5(F.encode("c.chunk", "UTF-8")).alias("digest"))


@query(
    """WITH x AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '```python' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '  ```' || chr(10) || text || '```  ' ELSE text END AS s FROM conversations)
    SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(s, ''), '^\\s+|\\s+$', '', 'g'), '^```(python|py)?[ \\t]*\\n?', ''), '\\n?```$', ''), '^\\s+|\\s+$', '', 'g')) AS digest FROM x"""
)
def fence_strip(t):
    s = F.expr("case turn % 3 when 0 then concat('```python\n', text, '\n```') when 1 then concat('  ```\n', text, '```  ') else text end")
    return t.conversations.select("conv_id", "turn", F.md5(F.encode(X.strip_code_fences(s), "UTF-8")).alias("digest"))


@query("""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(props || ' {"ok": true, "no": false, "x": null, "trueish": 1}', '\\btrue\\b', 'True', 'g'), '\\bfalse\\b', 'False', 'g'), '\\bnull\\b', 'None', 'g') AS s FROM events""")
def literal_fix(t):
    return t.events.select("event_id", X.python_literals(F.concat("props", F.lit(' {"ok": true, "no": false, "x": null, "trueish": 1}'))).alias("s"))


def _latex_sql(c: str) -> str:
    out = f"replace({c}, chr(92), chr(1))"
    for a, b in X.LATEX:
        out = f"replace({out}, '{a}', '{b}')"
    return f"replace({out}, chr(1), '\\textbackslash{{}}')"


@query(f"SELECT doc_id, md5({_latex_sql('coalesce(text, chr(32))')}) AS digest FROM documents")
def latex_escape(t):
    return t.documents.select("doc_id", F.md5(F.encode(X.latex_escape(F.coalesce("text", F.lit(" "))), "UTF-8")).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(text || ' ok ' || chr(128512) || chr(9731) || chr(8804) || chr(8594) || chr(8212) || chr(127) || chr(20013) || '!', '[^\\x00-\\x7E\\x{80}-\\x{FF}\\x{2000}-\\x{206F}\\x{3000}-\\x{303F}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{FF00}-\\x{FFEF}\\p{L}\\p{N}\\p{P}\\p{Z}]', '', 'g')) AS digest FROM documents")
def emoji_strip(t):
    return t.documents.select("doc_id", F.md5(F.encode(X.strip_emoji(F.concat("text", F.lit(" ok \U0001f600☃≤→—\x7f中!"))), "UTF-8")).alias("digest"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE printf('%.3f', c_acctbal) END AS s FROM customer")
def optional_format(t):
    return t.customer.select(F.col("c_custkey").alias("id"), X.format_optional(F.expr("if(c_custkey % 5 = 0, null, c_acctbal)")).alias("s"))


@query("SELECT doc_id, CAST(greatest(1, length(coalesce(text, '')) // 4) AS INTEGER) AS tokens FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT event_id, CAST(coalesce(props ->> '$.k', '0') AS INTEGER) AS k FROM events")
def json_field(t):
    return t.events.select("event_id", F.expr("cast(coalesce(get_json_object(props, '$.k'), '0') as int)").alias("k"))


@query("SELECT event_id, props AS j FROM events")
def json_extraction(t):
    s = F.expr("case event_id % 3 when 0 then props when 1 then concat('see ```json\n', props, '\n``` done') else concat('text ', props, ' more') end").alias("s")
    return t.events.select("event_id", s).select("event_id", X.best_json("s").alias("j"))


@query("SELECT o_orderkey AS id, list_sum([coalesce(TRY_CAST(trim(x) AS INTEGER), 0) FOR x IN string_split(o_orderkey || ', ' || o_custkey || ',x, 7', ',')])::BIGINT AS total FROM orders")
def label_parse(t):
    s = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit(",x, 7")).alias("s"))
    return s.select("id", F.aggregate(X.label_list("s"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("total"))


BARCODE = "'TCGA-' || c_nationkey || '-' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-01A' WHEN 2 THEN '-11A' WHEN 3 THEN '-xx' ELSE '-9' END"


@query(f"SELECT b AS barcode FROM (SELECT {BARCODE} AS b, c_custkey % 5 AS k FROM customer) WHERE k <> 2")
def tumour_filter(t):
    b = t.customer.select(F.expr(f"concat('TCGA-', c_nationkey, '-', c_custkey, {BARCODE[BARCODE.index('CASE'):]})").alias("barcode"))
    return b.filter(X.tumour_barcode("barcode"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'LumA' WHEN 1 THEN 'Her2' WHEN 2 THEN 'Basal' ELSE 'none' END AS label FROM part")
def label_canon(t):
    x = t.part.selectExpr("p_partkey as id", "case p_size % 4 when 0 then ' LUMA ' when 1 then 'her2' when 2 then 'Basal  ' else 'other' end as s")
    return x.select("id", F.coalesce(X.canonical_label("s"), F.lit("none")).alias("label"))


@query("SELECT l_suppkey AS gene, round(avg((abs(l_linenumber - 4) >= 2)::INT), 6) AS share FROM lineitem GROUP BY 1 ORDER BY avg((abs(l_linenumber - 4) >= 2)::INT) DESC, gene LIMIT 10")
def focal_events(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("gene")).agg(F.avg((F.abs(F.col("l_linenumber") - 4) >= 2).cast("int")).alias("s")).orderBy(F.desc("s"), "gene").limit(10).select("gene", r("s").alias("share"))


@query("SELECT event_type AS caller, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def trace_rollup(t):
    return t.events.groupBy(F.col("event_type").alias("caller")).agg(F.count("*").alias("calls"), r(F.sum("value"), 4).alias("total"), r(F.avg("value")).alias("mean"), F.count_distinct("user_id").alias("users"))


LOG = "SELECT CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'provider_fallback' ELSE 'call' END AS event, CAST(floor(abs(value)) AS BIGINT) AS tokens_in, user_id AS tokens_out, event_id % 10 = 0 AS is_retry, CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS provider FROM events"


def log(t):
    t.events.createOrReplaceTempView("__events")
    return t.spark.sql(LOG.replace("FROM events", "FROM __events"))


@query(f"WITH g AS ({LOG}) SELECT count(*) FILTER (event = 'call') AS calls, count(*) FILTER (event <> 'call' OR is_retry) AS retries, sum(tokens_in) FILTER (event = 'call')::BIGINT AS prompt_tokens, sum(tokens_out) FILTER (event = 'call')::BIGINT AS completion_tokens FROM g")
def trace_stats(t):
    return T.trace_stats(log(t))


@query(f"WITH g AS ({LOG}), p AS (SELECT * FROM (VALUES ('a', 0.00014, 0.00028), ('b', 0.0004, 0.0012), ('c', 0.005, 0.015)) v(provider, i, o)) SELECT provider, count(*) AS calls, round(sum(tokens_in / 1000 * i::DOUBLE + tokens_out / 1000 * o::DOUBLE), 6) AS cost FROM g JOIN p USING (provider) GROUP BY provider")
def trace_cost(t):
    prices = t.spark.createDataFrame([("a", 0.00014, 0.00028), ("b", 0.0004, 0.0012), ("c", 0.005, 0.015)], "provider string, price_in double, price_out double")
    return T.call_costs(log(t), prices).select("provider", "calls", r("cost").alias("cost"))


@query("SELECT conv_id, max(turn) AS updated, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY updated DESC, conv_id DESC LIMIT 30")
def session_cap(t):
    return T.newest(t.conversations, "conv_id", "turn", 30)


@query("SELECT doc_id, lang FROM documents WHERE trim(CASE WHEN doc_id % 4 = 0 THEN '  ' WHEN doc_id % 4 = 1 THEN NULL ELSE lang END) <> ''")
def label_filter(t):
    d = t.documents.selectExpr("doc_id", "case when doc_id % 4 = 0 then '  ' when doc_id % 4 = 1 then null else lang end as lang")
    return T.keep_labelled(d, "lang")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def dedupe_first(t):
    return T.first_per_key(t.lineitem, "l_partkey", ["l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def label_attach(t):
    right = t.labels.select("doc_id", "quality", F.col("toxic").alias("pos"))
    return T.attach_last(t.documents.select("doc_id"), right, "doc_id", "pos", "quality").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


HASHED = "(vec_id * 1103515245 + 12345) % 2147483648"


@query(f"SELECT vec_id, label, r <= floor(n * 0.7) AS train FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {HASHED}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def strat_split(t):
    return T.stratified_split(t.embeddings.select("vec_id", "label"), "vec_id", "label", 0.7)


@query(f"SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {HASHED}, vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings")
def strat_folds(t):
    return T.stratified_folds(t.embeddings.select("vec_id", "label"), "vec_id", "label", 5)


@query("WITH p AS (SELECT quantile_cont(c_acctbal, 0.3333333333333333) AS a, quantile_cont(c_acctbal, 0.6666666666666666) AS b FROM customer) SELECT c_custkey AS id, CAST((a <= c_acctbal)::INT + (b <= c_acctbal)::INT AS INTEGER) AS bin FROM customer, p")
def quantile_bins(t):
    return T.quantile_bin(t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal"), "c_acctbal", 3).select("id", "bin")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 50 = 0")
def strided_sample(t):
    return T.strided(t.orders, "o_orderkey", 50).select("o_orderkey", "o_totalprice")


@query("SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)")
def value_counts(t):
    c = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.select("source", "lang", "n", r(F.col("n") / F.sum("n").over(Window.partitionBy("source"))).alias("share"))


@query(
    """WITH g AS (SELECT user_id % 7 AS run, event_id AS pos, CASE WHEN event_type = 'click' THEN 'attempt ' || (event_id % 5) || ' started' WHEN event_type = 'view' THEN 'run succeeded' WHEN event_id % 3 = 0 THEN 'soft failure' ELSE 'failed: ' || event_id END AS line FROM events)
    SELECT run, CAST(coalesce(max(TRY_CAST(nullif(regexp_extract(line, 'attempt (\\d+)', 1), '') AS INTEGER)), 0) AS INTEGER) AS attempts, bool_or(line LIKE '%succeeded%') AS success, count(*) FILTER (line LIKE '%soft failure%') AS soft_failures, arg_max(line, pos) FILTER (line LIKE 'failed%') AS error FROM g GROUP BY run"""
)
def healing_stats(t):
    g = t.events.selectExpr("user_id % 7 as run", "event_id as pos", "case when event_type = 'click' then concat('attempt ', event_id % 5, ' started') when event_type = 'view' then 'run succeeded' when event_id % 3 = 0 then 'soft failure' else concat('failed: ', event_id) end as line")
    return T.healing_stats(g, r"attempt (\d+)", "succeeded", "soft failure", "^failed")


# Relational extensions of the driver tables; not operators of the clustering workbench.


@query("SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total")).select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "total")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL '2 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, s"""
)
def ext_sessions(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    new = F.when(F.col("ts") > F.lag("ts").over(w) + F.expr("interval 2 hours"), 1).when(F.lag("ts").over(w).isNull(), 1).otherwise(0)
    s = e.withColumn("new", new).withColumn("s", F.sum("new").over(w))
    return s.groupBy("user_id", "s").agg(F.unix_timestamp(F.min("ts")).alias("start"), F.count("*").alias("n")).drop("s")


@query(
    """WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
    SELECT event_id, round(coalesce(value, -1), 4) AS value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts"""
)
def ext_asof(t):
    p = t.events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    c = t.events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return T.as_of(c, p, "user_id", "ts", "value").select("event_id", r(F.coalesce("value", F.lit(-1.0)), 4).alias("value"))


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(t):
    c = t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return c.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "revenue")


@query("SELECT 'with' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def ext_semi_anti(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    a = t.customer.join(o, "c_custkey", "left_semi").agg(F.lit("with").alias("kind"), F.count("*").alias("n"))
    return a.unionByName(t.customer.join(o, "c_custkey", "left_anti").agg(F.lit("without").alias("kind"), F.count("*").alias("n")))


@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def ext_set_operations(t):
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    named = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return named(a.intersect(b), "both").unionByName(named(a.exceptAll(b).join(b, "k", "left_anti").distinct(), "customer only")).unionByName(named(a.union(b).distinct(), "either"))


@query("SELECT l_orderkey, l_linenumber, CAST(rank() OVER w AS INTEGER) AS rank, round(coalesce(lag(l_extendedprice) OVER w, -1), 2) AS before, round(avg(l_extendedprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def ext_window_frames(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.rank().over(w).alias("rank"), r(F.coalesce(F.lag("l_extendedprice").over(w), F.lit(-1.0)), 2).alias("before"),
        r(F.avg("l_extendedprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"),
    )


@query("SELECT c_mktsegment, count(*) AS orders, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE' GROUP BY 1")
def ext_star_join(t):
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.filter("r_name = 'EUROPE'").groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.count_distinct("c_custkey").alias("customers"), r(F.sum("o_totalprice"), 2).alias("total"))
