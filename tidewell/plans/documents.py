"""Queries over documents and their annotations: cleaning, tickers, JSON, views, incremental work, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as J, scalar, text as X
from ..operators import gaps as G, upsert as U, views as V
from .base import DAILY, daily_bars, pred_sql, predictions, query, rnd, sql_rnd, sql_stamp, stamp, table

# Fixed entities that the test pages hold; `&amp;`, which may go without its semicolon, last, so that nothing is unescaped twice.
_ENTITIES = {"&nbsp;": "\u00a0", "&copy;": "\u00a9", "&middot;": "\u00b7", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'"}
ENTITY_SQL = "html"
for _k, _v in _ENTITIES.items():
    ENTITY_SQL = f"replace({ENTITY_SQL}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"
ENTITY_SQL = f"regexp_replace({ENTITY_SQL}, '&amp;?', '&', 'g')"
STRIPPED = f"regexp_replace({ENTITY_SQL}, '<[^>]+>', ' ', 'g')"



@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def t1_repair_mojibake(spark, d):
    """Texts broken by a wrong charset come back as they were."""
    broken = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", F.md5(X.repair_mojibake(broken)).alias("text_md5"))


_N = {k: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in v)})))" for k, v in X.STOP_WORDS.items()}


@query(f"WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents), n AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _N.items())} FROM w) SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'unknown' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS lang, CASE WHEN greatest(de, en, es, fr) = 0 THEN 0.0 ELSE round(greatest(de, en, es, fr) / (de + en + es + fr), 6) END::DOUBLE AS share FROM n")
def t11_guess_language(spark, d):
    g = X.guess_language(F.col("text"))
    return table(spark, d, "documents").select("doc_id", g.alias("g")).select("doc_id", "g.lang", rnd("g.share", "share"))


@query(f"SELECT page_id, md5({STRIPPED}) AS plain_md5, length({STRIPPED}) AS n FROM pages")
def t2_strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.strip_html(F.col("html"))).alias("plain_md5"), F.length(X.strip_html(F.col("html"))).cast("long").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text || chr(7) || 'x' || chr(8203) || chr(10) || 'y', '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{9f}\\x{ad}\\x{200b}-\\x{200f}]', '', 'g')) AS clean_md5 FROM documents")
def t3_remove_control(spark, d):
    with_marks = F.concat(F.col("text"), F.lit("\x07x​\ny"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.remove_control(with_marks)).alias("clean_md5"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[\\t-\\r ]+', ' ', 'g'))) AS clean_md5 FROM documents")
def t4_collapse_space(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.collapse_space(F.col("text"))).alias("clean_md5"))


@query("SELECT page_id, 'see URL now' AS token, 'see [' || regexp_extract(lower(regexp_extract(url, '^[a-z]+://[^/?#]+')), '([^./]+\\.[^./]+)$', 1) || '] now' AS visible, 'see ' || upper(regexp_extract(lower(regexp_extract(url, '^[a-z]+://[^/?#]+')), '([^./]+\\.[^./]+)$', 1)) || '_TOKEN now' AS domain_token FROM pages")
def t5_replace_urls(spark, d):
    c = F.concat(F.lit("see "), F.col("url"), F.lit(" now"))
    return table(spark, d, "pages").select("page_id", X.replace_urls(c).alias("token"), X.replace_urls(c, "domain_visible").alias("visible"), X.replace_urls(c, "domain_token").alias("domain_token"))


@query("SELECT regexp_extract(lower(url), '([^./]+\\.[^./]+)(?:[/?#:].*)?$', 1) AS domain, count(*) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://[^/?#]+') AS url FROM pages) GROUP BY 1")
def t5_domains(spark, d):
    return table(spark, d, "pages").groupBy(X.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '@\\w+')) AS mentions, md5(regexp_replace(text, '@\\w+', '@USER', 'g')) AS clean_md5 FROM documents")
def t6_replace_mentions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"@\w+")).cast("long").alias("mentions"), F.md5(X.replace_mentions(F.col("text"))).alias("clean_md5"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def t7_strip_emoji(spark, d):
    """Emoji put in and stripped again."""
    return table(spark, d, "documents").select("doc_id", F.length(X.strip_emoji(F.concat(F.lit("\U0001f600❤️"), F.col("text"), F.lit("\U0001f1e9\U0001f1ea")))).cast("long").alias("n"))


# Runs spelt out character by character: the place of each character in its run.
@query("""WITH c AS (SELECT doc_id, unnest(ch) AS ch, generate_subscripts(ch, 1) AS i FROM (SELECT doc_id, string_split(text || ' cooooool!!!!!!', '') AS ch FROM documents)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ch, run ORDER BY i) AS n FROM r)
SELECT doc_id, md5(string_agg(ch, '' ORDER BY i)) AS clean_md5 FROM n WHERE n <= 3 OR ch IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)) GROUP BY doc_id""")
def t8_limit_runs(spark, d):
    c = F.concat(F.col("text"), F.lit(" cooooool!!!!!!"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.limit_elongation(X.limit_punctuation(c))).alias("clean_md5"))


@query("SELECT doc_id, md5(lower(text)) AS low_md5 FROM documents")
def t9_lower(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.lower("text")).alias("low_md5"))


CLEANED = f"trim(regexp_replace(regexp_replace({STRIPPED}, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}\\x{{ad}}\\x{{200b}}-\\x{{200f}}]', '', 'g'), '[\\t-\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


_URL = "'(?i)(?:https?|ftp)://\\S+'"


@query(f"""WITH c AS (SELECT page_id, {CLEANED} AS c FROM pages),
u AS (SELECT page_id, c, regexp_split_to_array(c, {_URL}) AS t, list_transform(regexp_extract_all(c, {_URL}), lambda x: upper(regexp_extract(lower(regexp_extract(x, '^(?i)[a-z]+://[^/?#:]+')), '([^./]+\\.[^./]+)$', 1)) || '_TOKEN') AS d FROM c)
SELECT page_id, md5(replace(regexp_replace(regexp_replace(c, {_URL}, 'URL', 'g'), '@\\w+', '@USER', 'g'), chr(169), '')) AS ml_md5,
       md5(regexp_replace(array_to_string(list_transform(range(len(t)), lambda i: t[i + 1] || coalesce(d[i + 1], '')), ''), '@\\w+', '@USER', 'g')) AS llm_md5 FROM u""")
def t10_clean_for_models(spark, d):
    """The form for models and the one for reading. Of pictographs the pages hold the copyright sign alone."""
    out = X.cleaned(table(spark, d, "pages"), "html", ml=("token", "strip"), llm=("domain_token", "keep"))
    return out.select("page_id", F.md5("ml").alias("ml_md5"), F.md5("llm").alias("llm_md5"))


@query("SELECT doc_id, concat_ws(' - ', nullif(trim(lang), ''), nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END), '')) AS combined FROM documents")
def t12_combine(spark, d):
    return table(spark, d, "documents").select("doc_id", X.combine(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source"))).alias("combined"))


@query("SELECT doc_id, sha256(trim(text)) AS content_hash FROM documents")
def t13_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query()
def t13_blake2b(spark, d):
    return table(spark, d, "documents").select("doc_id", X.blake2b(F.col("text")).alias("etl_hash"), X.blake2b(F.col("text"), 16).alias("scoring_hash"))


POST = "CASE event_type WHEN 'click' THEN 'Buy $TSLA and $AAPL or $TSLA' WHEN 'view' THEN 'NYSE: GE rises (MSFT) ON news' ELSE 'GE said nothing; big blue did ' || event_type END"


def _post():
    return F.when(F.col("event_type") == "click", "Buy $TSLA and $AAPL or $TSLA").when(F.col("event_type") == "view", "NYSE: GE rises (MSFT) ON news").otherwise(F.concat(F.lit("GE said nothing; big blue did "), F.col("event_type")))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'AAPL,TSLA' WHEN 'view' THEN 'GE,MSFT' ELSE 'GE,IBM' END AS tickers, CASE event_type WHEN 'click' THEN 'TSLA,AAPL' ELSE '' END AS explicit FROM events")
def t14_t15_tickers(spark, d):
    found = X.tickers(_post(), ["AAPL", "GE", "IBM", "MSFT", "TSLA", "ON"], {"big blue": "IBM"})
    return table(spark, d, "events").select("event_id", F.array_join(found, ",").alias("tickers"), F.array_join(X.explicit_tickers(_post()), ",").alias("explicit"))


@query("SELECT doc_id, CASE WHEN length(text) > 600 THEN left(text, 600) || '...' ELSE text END AS short FROM documents")
def t16_shorten(spark, d):
    return table(spark, d, "documents").select("doc_id", X.shorten(F.col("text"), 600, "...").alias("short"))


@query("SELECT doc_id, contains(text, left(text, 20)) AND contains(text, 'the ') AS supported FROM documents")
def t17_evidence(spark, d):
    return table(spark, d, "documents").select("doc_id", X.all_in(F.array(F.substring("text", 1, 20), F.lit("the ")), F.col("text")).alias("supported"))


# JSON


@query("SELECT event_id, 'ratios_ttm_' || event_type AS prefix FROM events")
def j4_endpoint_prefix(spark, d):
    """An endpoint's last part, with or without a slash or parameters behind it."""
    tail = F.when(F.col("event_id") % 3 == 0, "/").when(F.col("event_id") % 3 == 1, "?symbol=A-B/C").otherwise("")
    return table(spark, d, "events").select("event_id", J.endpoint_prefix(F.concat(F.lit("/stable/ratios-ttm-"), F.col("event_type"), tail)).alias("prefix"))


@query("SELECT user_id AS symbol, 'ratios_ttm.' || key AS feature, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS asof_date, event_id, CAST(json_extract_string(props, '$.' || key) AS DOUBLE) AS value FROM (SELECT *, unnest(json_keys(props)) AS key FROM events) WHERE key IN ('k')")
def j2_unpivot(spark, d):
    snaps = table(spark, d, "events").select(F.col("user_id").alias("symbol"), "event_id", "props", F.to_date("ts").alias("fetch_date"))
    out = J.unpivot(snaps, ["symbol", "event_id"], "props", J.endpoint_prefix(F.lit("/stable/ratios-ttm?symbol=X")), ["k"], "fetch_date")
    return out.select("symbol", "feature", F.date_format("asof_date", "yyyy-MM-dd").alias("asof_date"), "event_id", "value")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n FROM events")
def j1_payload_objects(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, F.col("props")).when(F.col("event_id") % 5 == 1, F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]"))).when(F.col("event_id") % 5 == 2, F.lit("7")).when(F.col("event_id") % 5 == 3, F.lit("")).otherwise(F.lit(None))
    return table(spark, d, "events").select("event_id", F.size(J.objects(raw)).alias("n"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN DATE '2024-01-05' WHEN 1 THEN DATE '2023-02-03' WHEN 2 THEN DATE '2022-01-01' ELSE CAST(ts AS DATE) END AS asof_date FROM events")
def j3_asof_fallback(spark, d):
    raw = F.element_at(F.array(F.lit('{"date":"2024-01-05 10:00","v":"1"}'), F.lit('{"date":"","reportedDate":"2023-02-03","v":"1"}'), F.lit('{"calendarYear":"2022","v":"1"}'), F.lit('{"v":"3"}')), (F.col("event_id") % 4 + 1).cast("int"))
    snaps = table(spark, d, "events").select("event_id", raw.alias("raw"), F.to_date("ts").alias("day"))
    return J.unpivot(snaps, ["event_id"], "raw", F.lit("p"), ["v"], "day").select("event_id", "asof_date")


@query("SELECT event_id, event_id % 6 IN (0, 5) AS good FROM events")
def j5_check_output(spark, d):
    base = '{"sentiment":"positive","confidence":7,"relevance":5,"explanation":"x","tickers":["A"],"scope":"company","evidence":["click"]'
    cases = [base + "}", base.replace("positive", "great") + "}", base.replace("7", "11") + "}", base + ',"extra":1}', "not json", base.replace('["click"]', "[]") + "}"]
    raw = F.element_at(F.array(*[F.lit(c) for c in cases]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", J.checked_output(raw, F.lit("a click text")).alias("good"))


@query("SELECT user_id, '[' || string_agg('\"' || event_type || '\"', ',' ORDER BY event_type) || ']' AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def j6_array_to_json(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("types"))


@query("SELECT event_id, CASE event_id % 6 WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN 12.5::DOUBLE ELSE NULL END AS number FROM events")
def p_lenient_number(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("", "true", "null", "12.5", "12,5", "NaN")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", scalar.to_number(raw).alias("number"))


# Annotations and incremental work

PREDS = "preds AS (SELECT 'doc' AS source, doc_id AS pred_id, 'm' || (doc_id % 2) AS model, 'v1' AS schema_version, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS sentiment FROM labels UNION ALL SELECT 'doc', doc_id, 'm2', 'v2', 'neutral' FROM labels WHERE toxic = 1)"


def annotations(spark, d):
    """Predictions of two versions made from labels: some documents have two, many none."""
    lab = table(spark, d, "labels")
    a = lab.select(F.lit("doc").alias("source"), F.col("doc_id").alias("pred_id"), F.concat(F.lit("m"), F.col("doc_id") % 2).alias("model"), F.lit("v1").alias("schema_version"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("sentiment"))
    b = lab.filter("toxic = 1").select(F.lit("doc"), "doc_id", F.lit("m2"), F.lit("v2"), F.lit("neutral")).toDF(*a.columns)
    return a.unionByName(b)


@query(f"WITH {PREDS} SELECT doc_id, lang, model, schema_version, sentiment FROM documents LEFT JOIN preds ON pred_id = doc_id AND preds.source = 'doc'")
def k1_with_predictions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return V.with_predictions(docs, annotations(spark, d), "doc", "doc_id").select("doc_id", "lang", "model", "schema_version", "sentiment")


@query(f"WITH {PREDS} SELECT 'page' AS kind, page_id AS id, model, sentiment FROM pages LEFT JOIN preds ON pred_id = page_id UNION ALL SELECT 'thread', conv_id, model, sentiment FROM conversations LEFT JOIN preds ON pred_id = conv_id WHERE turn = 0")
def k2_other_sources(spark, d):
    """k2_other_sources with page and thread annotations made from all labels: unmatched rows are those without a label."""
    a = annotations(spark, d).select("source", "pred_id", "model", "sentiment")
    every = a.unionByName(a.withColumn("source", F.lit("page"))).unionByName(a.withColumn("source", F.lit("thread")))
    pages = V.with_predictions(table(spark, d, "pages").select("page_id"), every, "page", "page_id").withColumnRenamed("page_id", "id")
    posts = V.with_predictions(table(spark, d, "conversations").filter("turn = 0").select("conv_id"), every, "thread", "conv_id").withColumnRenamed("conv_id", "id")
    return pages.withColumn("kind", F.lit("page")).unionByName(posts.withColumn("kind", F.lit("thread"))).select("kind", "id", "model", "sentiment")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def k3_enriched(spark, d):
    return V.enriched(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k4_unprocessed(spark, d):
    return V.unprocessed(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query(f"WITH {PREDS} SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT pred_id FROM preds WHERE model = 'm2' AND schema_version = 'v2')")
def k5_unscored(spark, d):
    return V.unscored(table(spark, d, "labels"), annotations(spark, d), "doc", "doc_id", "m2", "v2").select("doc_id", "quality")


@query("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS i FROM conversations WHERE turn > 0),
b AS (SELECT conv_id, string_agg('- ' || CASE WHEN length(text) > 600 THEN left(text, 600) || '...' ELSE text END, chr(10) ORDER BY i) AS t, count(*) AS n FROM c WHERE i <= 5 GROUP BY conv_id)
SELECT p.conv_id, md5(concat_ws(chr(10), p.text, b.t)) AS thread_md5, CAST(coalesce(n, 0) AS INTEGER) AS n_comments FROM conversations p LEFT JOIN b USING (conv_id) WHERE p.turn = 0""")
def k6_threads(spark, d):
    c = table(spark, d, "conversations")
    posts, comments = c.filter("turn = 0").select("conv_id", "text"), c.filter("turn > 0").withColumn("score", F.length("text")).withColumn("turn_id", F.col("turn"))
    t = V.threads(posts, comments, "conv_id", "score", "turn", "turn_id")
    return t.select("conv_id", F.md5("thread").alias("thread_md5"), "n_comments")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn > 0 AND role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) <= 7")
def s6_top_comments(spark, d):
    c = table(spark, d, "conversations").filter("turn > 0 AND role <> 'system'")
    return V.top_per_group(c, ["conv_id"], [F.length("text").desc(), F.col("turn")], 7).select("conv_id", "turn", "role")


@query("SELECT 'doc' AS source, doc_id AS id, lang, NULL AS url, length(text) AS n FROM documents UNION ALL SELECT 'page', page_id, NULL, url, length(html) FROM pages UNION ALL SELECT 'item', item_id, NULL, NULL, length(text) FROM benchmark UNION ALL SELECT 'turn', conv_id * 1000 + turn, NULL, NULL, length(text) FROM conversations")
def x1_union_views(spark, d):
    n = lambda c: F.length(c).cast("long").alias("n")
    views = {
        "doc": table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", n("text")),
        "page": table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", n("html")),
        "item": table(spark, d, "benchmark").select(F.col("item_id").alias("id"), n("text")),
        "turn": table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), n("text")),
    }
    return V.union_views(views).select("source", "id", "lang", "url", "n")


@query(f"WITH {DAILY}, {pred_sql(1, 'p1')}, {pred_sql(2, 'p2')} SELECT symbol, {sql_stamp('timestamp')}, horizon, {sql_rnd('y_true')} FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)")
def x2_concatenate(spark, d):
    b = daily_bars(spark, d)
    return predictions(b, 1).unionByName(predictions(b, 2)).select("symbol", stamp("timestamp"), "horizon", rnd("y_true"))


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'click' INTERSECT SELECT DISTINCT strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'purchase'")
def x3_common_days(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase")).withColumn("day", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
    return V.common_days(e, "event_type", "day")


@query("SELECT user_id FROM events WHERE value > 150 UNION SELECT user_id FROM events WHERE event_type = 'purchase'")
def x4_union_distinct(spark, d):
    e = table(spark, d, "events")
    return e.filter("value > 150").select("user_id").union(e.filter("event_type = 'purchase'").select("user_id")).distinct()


@query("SELECT 'documents' AS missing_in, unnest(['quality', 'toxic']) AS column_name")
def x5_column_difference(spark, d):
    """Columns of one table that another one lacks."""
    gone = [c for c in table(spark, d, "labels").columns if c not in table(spark, d, "documents").columns]
    return spark.range(1).select(F.lit("documents").alias("missing_in"), F.explode(F.array(*[F.lit(c) for c in gone])).alias("column_name"))


@query("SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a3_missing_count(spark, d):
    return V.unprocessed(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def a1_count_by_symbol(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM events GROUP BY user_id")
def a2_first_time(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts")).select("user_id", stamp("first_ts"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def o1_latest_rows(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "user_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC")
def o2_rows_of_symbol(spark, d):
    return table(spark, d, "events").filter("user_id = 7").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", stamp("ts"))


@query("SELECT event_id, user_id FROM events WHERE ts > (SELECT ts FROM events WHERE event_id = 500) OR (ts = (SELECT ts FROM events WHERE event_id = 500) AND event_id > 500) ORDER BY ts, event_id LIMIT 100")
def o4_keyset_page(spark, d):
    e = table(spark, d, "events")
    at = e.filter("event_id = 500").select("ts").first()[0]
    return V.keyset_page(e, "ts", "event_id", (str(at), 500), 100).select("event_id", "user_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def o3_longest_documents(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "n_chars")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN text END, source) AS body FROM documents")
def p5_coalesce(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.col("source")).alias("body"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS epoch, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE floor(epoch(ts)) END::DOUBLE AS order_key FROM events")
def p6_p7_epoch(spark, d):
    known = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    return table(spark, d, "events").select("event_id", scalar.epoch(F.col("ts")).alias("epoch"), scalar.order_key(known, F.lit(None).cast("timestamp_ntz")).alias("order_key"))


@query("SELECT doc_id, 'new' AS processed_at, toxic FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'old', toxic FROM labels WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0")
def u4_upsert_touch(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    old = lab.filter("doc_id % 2 = 0").withColumn("processed_at", F.lit("old"))
    return U.upsert_touch(old, lab.filter("doc_id % 3 = 0"), ["doc_id"], "processed_at", F.lit("new")).select("doc_id", "processed_at", "toxic")


@query(f"WITH {PREDS}, n AS (SELECT DISTINCT source, pred_id, model, schema_version FROM preds WHERE pred_id % 5 = 0) SELECT source, pred_id, model, schema_version, 'neutral' AS sentiment, 2 AS created_at FROM n UNION ALL SELECT p.source, p.pred_id, p.model, p.schema_version, p.sentiment, 1 FROM preds p WHERE pred_id % 5 <> 0")
def u5_upsert_predictions(spark, d):
    key = ["source", "pred_id", "model", "schema_version"]
    old = annotations(spark, d).withColumn("created_at", F.lit(1))
    new = old.filter("pred_id % 5 = 0").select(*key).distinct().withColumn("sentiment", F.lit("neutral"))
    return U.upsert_touch(old, new, key, "created_at", F.lit(2)).select(*key, "sentiment", "created_at")


@query("SELECT o_orderpriority AS indicator_name, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS value FROM orders WHERE o_orderkey % 4 <> 0")
def s4_macro_points(spark, d):
    """Points as text; those that are no number are skipped."""
    raw = F.when(F.col("o_orderkey") % 4 == 0, ".").otherwise(F.col("o_totalprice").cast("string"))
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("indicator_name"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("date"), raw.try_cast("double").alias("value"))
    return o.filter("value IS NOT NULL")


@query("SELECT min(page_id) AS page_id, url FROM pages WHERE page_id % 4 <> 0 GROUP BY url")
def s5_articles(spark, d):
    """Articles out of a JSON answer: those without url are left out, the first of a url stays."""
    from pyspark.sql import Window

    article = F.struct(F.when(F.col("page_id") % 4 != 0, F.col("url")).alias("url"), F.col("page_id"))
    answers = table(spark, d, "pages").groupBy((F.col("page_id") % 16).alias("batch")).agg(F.to_json(F.struct(F.collect_list(article).alias("articles"))).alias("raw"))
    rows = answers.select(F.explode(F.from_json("raw", "articles array<struct<url:string,page_id:bigint>>")["articles"]).alias("a")).select("a.*").filter("url IS NOT NULL")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("page_id"))).filter("n = 1").select("page_id", "url")


@query("SELECT event_id % 3 AS endpoint, user_id AS symbol, last(props ORDER BY ts, event_id) AS data_json FROM events GROUP BY 1, 2")
def s7_snapshots(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 3).alias("endpoint"), F.col("user_id").alias("symbol"), "props", "ts", "event_id")
    return e.groupBy("endpoint", "symbol").agg(F.max_by("props", F.struct("ts", "event_id")).alias("data_json"))


@query("""WITH s AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 14 HOUR AS opens, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 21 HOUR AS closes FROM events), st AS (SELECT unnest(generate_series(opens, closes - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS t FROM s),
g AS (SELECT user_id AS symbol, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS a, ts AS b FROM events)
SELECT symbol, CAST(count(*) AS BIGINT) AS missing FROM g JOIN st ON t > date_trunc('second', a) AND t < date_trunc('second', b) WHERE floor(epoch(b)) - floor(epoch(a)) > 7200 GROUP BY symbol""")
def k13_bars_in_gaps(spark, d):
    """How many bar starts of the sessions lie inside a symbol's gaps."""
    e = table(spark, d, "events")
    gaps = G.find_gaps(e.select(F.col("user_id").alias("symbol"), "ts"), 7200, time="ts")
    at = lambda s: F.concat_ws(" ", F.col("date").cast("string"), F.lit(s)).cast("timestamp_ntz")
    sessions = e.select(F.to_date("ts").alias("date")).distinct().select("date", at("14:00:00").alias("opens"), at("21:00:00").alias("closes"))
    return G.expected_in_gaps(gaps, sessions, 3600).groupBy("symbol").agg(F.sum("expected_bars").alias("missing")).filter("missing > 0")


@query(f"WITH {DAILY} SELECT symbol, {sql_stamp('timestamp')} FROM (SELECT symbol, timestamp, lead(close, 1) OVER w AS a, lead(close, 3) OVER w AS b, lead(close, 7) OVER w AS c FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def k14_common_horizons(spark, d):
    """Keys that have a target at every horizon: one window, no join."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("timestamp")
    b = daily_bars(spark, d).select("symbol", "timestamp", *[F.lead("close", h).over(w).alias(f"c{h}") for h in (1, 3, 7)])
    return b.dropna().select("symbol", stamp("timestamp"))
