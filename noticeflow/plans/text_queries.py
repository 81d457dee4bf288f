"""Driver queries over text, addresses, pages, links and state on disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow import policy
from noticeflow.functions import dates as windows
from noticeflow.functions import text, urls
from noticeflow.operators import linkage, segments
from noticeflow.plans.state_queries import AS_OF, BEFORE, NOW, SEEN_INDEX, listing
from noticeflow.plans.tables import day, dealt, table
from noticeflow.sources import pages, state_store
from noticeflow.streaming import incremental

_N = "lower(trim(regexp_replace(strip_accents(coalesce(text, '')), '\\s+', ' ', 'g')))"
_URL = "regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)', {})"


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-noticeflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/noticeflow/{uuid.uuid4().hex}"


def checkpointed(spark: SparkSession):
    root = _shared(spark)

    def write(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def normalised_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are alike once normalised: the last one of each, by id."""
    d = table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n_docs"))


NORMALISED_FINGERPRINT = f"SELECT sha256({_N}) AS fingerprint, max(doc_id) AS last_doc, count(*) AS n_docs FROM documents GROUP BY 1"


def canonical_pages(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.key_form(u).alias("key_url"), urls.fetch_form(u).alias("fetch_url"), urls.stable_id(u).alias("stable_id"), urls.admissible(u).alias("admissible")
    )


_KEY = f"lower({_URL.format(1)}) || '://' || lower({_URL.format(2)}) || regexp_replace(regexp_replace({_URL.format(3)}, '/+', '/', 'g'), '/$', '')"
CANONICAL_PAGES = f"""SELECT page_id, {_KEY} AS key_url, lower({_URL.format(1)}) || '://' || lower({_URL.format(2)})
  || CASE WHEN {_URL.format(3)} = '' THEN '/' ELSE {_URL.format(3)} END || regexp_extract(url, '(\\?[^#]*)', 1) AS fetch_url,
  substr(sha256({_KEY}), 1, 20) AS stable_id,
  lower({_URL.format(1)}) IN ('http', 'https') AND NOT regexp_matches({_URL.format(2)}, ':[0-9]*$') AND {_URL.format(2)} <> '' AS admissible FROM pages"""


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("base", F.lit("https://site.example.org/list/"))
    return pages.links(p, "page_id", "html", "base")


PAGE_LINKS = """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS t,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS p FROM pages)
SELECT page_id, p::INT AS position, 'https://site.example.org' || h AS url, trim(t) AS label FROM l"""


#: Words for the driver's invented labels, in place of the policy's own.
LABEL_WORDS = ((("the", "der", "des"), 45), (("tion", "que"), 24), (("en",), 20))


def link_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The links of each page that are worth following, scored by what their labels say."""
    found = page_links(spark, sf).filter(~urls.excluded(F.col("url"))).withColumn("said", text.normalised(F.col("label")))
    score = linkage.link_score(F.col("said"), F.col("url"), F.lit(False), F.lit(0), 1900, LABEL_WORDS)
    scored = found.withColumn("score", score)
    return linkage.best_links(scored, ["page_id"], "url", "score", "position", linkage.LEAST_LINK).select("page_id", "url", "score", "rank")


_SAID = lambda words: " OR ".join(f"contains(s, '{w}')" for w in words)
_WEIGHED = " + ".join(f"CASE WHEN {_SAID(ws)} THEN {n} ELSE 0 END" for ws, n in (*LABEL_WORDS, (("1900",), 30), (policy.LATE_WORDS, -30), (linkage.RESULT_WORDS, -120)))
LINK_TOP_K = f"""WITH l AS ({PAGE_LINKS}),
s AS (SELECT page_id, url, position, lower(trim(regexp_replace(strip_accents(label), '\\s+', ' ', 'g'))) || ' ' || lower(url) AS s FROM l
  WHERE NOT regexp_matches(lower(regexp_replace(url, '^https?://[^/]*', '')), '^({"|".join(policy.EXCLUDED_PATHS)})(/|$)')),
k AS (SELECT page_id, url, max({_WEIGHED}) AS score, min(position) AS p FROM s GROUP BY 1, 2)
SELECT page_id, url, score::INT AS score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, p)::INT AS rank FROM k WHERE score >= {linkage.LEAST_LINK}"""


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.visible_text(table(spark, sf, "pages"), "page_id", "html", None)
    said = F.regexp_replace("text", r"[^\p{L}]+", " ")  # tags are gone: what is left between letters may differ
    return found.select("page_id", "title", "blocked", F.trim(said).alias("said"))


_VISIBLE = "html"
for _tag in ("head", "script", "style", "nav", "footer"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '<{_tag}[ >].*?</{_tag}>', ' ', 'gs')"
#: References as HTML decodes them: these names need no semicolon behind them, and what one leaves is not decoded again.
_REFERENCE = "&(?:[a-z]+;|amp|quot|copy|middot|lt|gt)"
PAGE_TEXT = f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS title,
  false AS blocked, trim(regexp_replace(regexp_replace(regexp_replace({_VISIBLE}, '<[^>]*>', ' ', 'g'), '{_REFERENCE}', ' ', 'g'), '[^\\p{{L}}]+', ' ', 'g')) AS said FROM pages"""


def date_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written in three ways into a sentence, and read back."""
    d = day("o_orderdate")
    months = F.array(*[F.lit(m) for m in ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")])
    written = F.concat_ws(" de ", F.dayofmonth(d).cast("string"), F.get(months, F.month(d) - 1), F.year(d).cast("string"))
    later = F.date_add(d, 10)
    sentence = F.concat(F.lit("Aberto de "), written, F.lit(" até "), F.date_format(later, "d/M/yyyy"), F.lit("; 31-02-2020 e "), F.date_format(d, "dd-MM-yyyy"))
    found = text.dates(sentence, F.lit(AS_OF).cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(found, lambda x: x.cast("string")), " ").alias("dates"))


DATE_MENTIONS = "SELECT o_orderkey, o_orderdate::DATE || ' ' || (o_orderdate::DATE + 10) AS dates FROM orders"


def window_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence on applications is chosen over those on fees and results."""
    d, later = day("o_orderdate"), F.date_add(day("o_orderdate"), 20)
    show = lambda x: F.date_format(x, "dd/MM/yyyy")
    body = F.concat(
        F.lit("Publicado. As inscrições estarão abertas de "), show(d), F.lit(" a "), show(later),
        F.lit(". O pedido de isenção da taxa de inscrição vai até "), show(F.date_add(d, 40)), F.lit(". Resultado em "), show(F.date_add(d, 90)), F.lit("."),
    )
    docs = table(spark, sf, "orders").select("o_orderkey", body.alias("body"))
    return windows.application_window(docs, "o_orderkey", "body", F.lit(AS_OF).cast("date"))


WINDOW_CHOICE = "SELECT o_orderkey, o_orderdate::DATE AS registration_start, o_orderdate::DATE + 20 AS registration_end FROM orders"


def interval_check(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    odd = F.col("l_orderkey") % 2 == 1
    start, end = windows.valid_window(F.when(odd, F.col("b")).otherwise(F.col("a")), F.when(odd, F.col("a")).otherwise(F.col("b")))
    return lines.select("l_orderkey", start.alias("window_start"), end.alias("window_end"))


INTERVAL_CHECK = """WITH l AS (SELECT l_orderkey, min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 OR a = b THEN a END AS window_start, CASE WHEN l_orderkey % 2 = 0 OR a = b THEN b END AS window_end FROM l"""


def marker_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("at", F.unix_timestamp("ts"))
    return segments.marker_runs(e, ["user_id"], "event_type", "at", 3600, ["event_id"]).select("user_id", "run", "event_type", "first", "last", "n_marks", "next")


MARKER_RUNS = """WITH e AS (SELECT user_id, event_type, event_id, floor(epoch(ts))::BIGINT AS sec FROM events),
n AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR sec - lag(sec) OVER w > 3600 THEN 1 ELSE 0 END AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY sec, event_id)::BIGINT AS run FROM n),
g AS (SELECT user_id, run, min(event_type) AS event_type, min(sec) AS first, max(sec) AS last, count(*) AS n_marks FROM r GROUP BY user_id, run)
SELECT *, lead(first) OVER (PARTITION BY user_id ORDER BY run) AS next FROM g"""


def requirement_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Requirement phrases composed from part columns, and taken apart by level."""
    body = F.concat(F.lit("Exige graduação em "), "p_brand", F.lit("; e mestrado em "), "p_type", F.lit("; ou graduação em "), "p_name")
    docs = table(spark, sf, "part").select("p_partkey", body.alias("body"))
    marks = {"graduation": r"graduação em", "masters": r"mestrado em"}
    return segments.requirement_fields(docs, "p_partkey", "body", marks).select("p_partkey", "graduation", "masters")


REQUIREMENT_FIELDS = """SELECT p_partkey, 'graduação em ' || p_brand || '; e / graduação em ' || p_name AS graduation, 'mestrado em ' || p_type || '; ou' AS masters FROM part"""


def evidence_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as lines; those of users hold evidence, with the two turns before and after."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("line"), F.col("role").alias("r"))
    return segments.context_windows(c, ["conv_id"], "turn", "line", F.col("r") == "user").select("conv_id", "turn", "excerpt")


EVIDENCE_WINDOWS = """WITH c AS (SELECT conv_id, turn, role, string_agg(role || ' ' || turn, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS excerpt FROM conversations)
SELECT conv_id, turn, excerpt FROM c WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id, excerpt ORDER BY turn) = 1"""


def marker_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A user's turn opens a block of a conversation."""
    c = table(spark, sf, "conversations")
    rows = segments.blocks(c, ["conv_id"], ["turn"], F.col("role") == "user")
    return segments.block_texts(rows, ["conv_id"], ["turn"], "role", ["turn"]).select("conv_id", "block", "text", "n_lines", "turn")


MARKER_BLOCKS = """WITH b AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS block FROM conversations)
SELECT conv_id, block, string_agg(role, chr(10) ORDER BY turn) AS text, count(*) AS n_lines, min(turn) AS turn FROM b WHERE block > 0 GROUP BY conv_id, block"""


def heading_carry_down(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    heading = F.when(F.col("role") == "user", F.length("text"))
    return segments.carried_down(c, ["conv_id"], ["turn"], heading).select("conv_id", "turn", "heading")


HEADING_CARRY_DOWN = """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn)::INT AS heading
FROM conversations"""


def best_extractor(spark: SparkSession, sf: str) -> DataFrame:
    """Two ways to cut a document into rows: by lines and by sentences; the one with more rows wins."""
    d = table(spark, sf, "documents")
    line = d.select("doc_id", F.lit(0).alias("extractor"), F.explode(F.split("text", "\n", -1)).alias("piece"))
    stop = d.select("doc_id", F.lit(1).alias("extractor"), F.explode(F.split("text", r"\. ", -1)).alias("piece"))
    found = segments.best_extractor(line.unionByName(stop), ["doc_id"], "extractor")
    return found.groupBy("doc_id", "extractor").agg(F.count(F.lit(1)).alias("n_rows"))


BEST_EXTRACTOR = """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS a, len(string_split(text, '. ')) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (b > a)::INT AS extractor, greatest(a, b) AS n_rows FROM n"""


def id_match(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as notices with a number in their label, parts as documents that name one."""
    year = F.date_format("o_orderdate", "yyyy")
    label = F.concat(F.lit("EDITAL Nº 00"), (F.col("o_orderkey") % 997).cast("string"), F.lit("/"), year)
    label = F.regexp_replace(label, "00([0-9]{3})/", "$1/")
    notices = dealt(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", linkage.notice_numbers(label).alias("numbers"))
    name = F.concat(F.lit("Concurso público, edital n. "), (F.col("p_partkey") % 997).cast("string"), F.lit("/"), (F.lit(1995) + F.col("p_size") % 7).cast("string"))
    documents = table(spark, sf, "part").select("p_partkey", linkage.notice_numbers(name).alias("numbers"))
    return linkage.id_matches(notices, documents, "o_orderkey", "p_partkey")


ID_MATCH = """SELECT o_orderkey, p_partkey, (o_orderkey % 997) || '/' || right(year(o_orderdate)::VARCHAR, 2) AS number FROM orders JOIN part
  ON o_orderkey % 997 = p_partkey % 997 AND year(o_orderdate) = 1995 + p_size % 7"""


def id_match_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same over all orders, with numbers that few of them share."""
    label = lambda k, year: F.concat(F.lit("Concurso público, EDITAL Nº "), F.lpad((F.col(k) % 9973).cast("string"), 4, "0"), F.lit("/"), year)
    notices = dealt(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", linkage.notice_numbers(label("o_orderkey", F.date_format("o_orderdate", "yyyy"))).alias("numbers"))
    named = label("p_partkey", (F.lit(1995) + F.col("p_size") % 7).cast("string"))
    documents = table(spark, sf, "part").select("p_partkey", linkage.notice_numbers(named).alias("numbers"))
    return linkage.id_matches(notices, documents, "o_orderkey", "p_partkey")


ID_MATCH_ALL = """SELECT o_orderkey, p_partkey, (o_orderkey % 9973) || '/' || right(year(o_orderdate)::VARCHAR, 2) AS number FROM orders JOIN part
  ON o_orderkey % 9973 = p_partkey % 9973 AND year(o_orderdate) = 1995 + p_size % 7"""


def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and benchmark items by their long words in common, of nine letters and more."""
    b = table(spark, sf, "benchmark").select("item_id", linkage.tokens(F.col("text"), (), 9).alias("words"))
    d = table(spark, sf, "documents").select("doc_id", linkage.tokens(F.col("text"), (), 9).alias("words"))
    return linkage.token_matches(d, b, "doc_id", "item_id", "words").filter("n_common >= 3")


TOKEN_OVERLAP = f"""WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_N}, '[a-z0-9]{{9,}}')) AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_N}, '[a-z0-9]{{9,}}')) AS w FROM benchmark)
SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN b USING (w) GROUP BY 1, 2 HAVING count(*) >= 3"""


def token_overlap_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same with all words of four letters and more, without common ones."""
    b = table(spark, sf, "benchmark").select("item_id", linkage.tokens(F.col("text")).alias("words"))
    d = table(spark, sf, "documents").select("doc_id", linkage.tokens(F.col("text")).alias("words"))
    return linkage.token_matches(d, b, "doc_id", "item_id", "words").filter("n_common >= 3")


_TOKENS = f"unnest(list_distinct(list_filter(regexp_extract_all({_N}, '[a-z0-9]{{4,}}'), lambda w: w NOT IN {linkage.COMMON_WORDS}))) AS w"
TOKEN_OVERLAP_ALL = f"""WITH d AS (SELECT DISTINCT doc_id, {_TOKENS} FROM documents), b AS (SELECT DISTINCT item_id, {_TOKENS} FROM benchmark)
SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN b USING (w) GROUP BY 1, 2 HAVING count(*) >= 3"""


def registry_match(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as notices, lines as registry rows: by order number, words and dates."""
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.array(F.col("o_orderkey").cast("string"))).otherwise(F.array().cast("array<string>")).alias("numbers"),
        F.array("o_orderpriority", F.col("o_custkey").cast("string")).alias("words"),
        F.array(day("o_orderdate"), F.date_add(day("o_orderdate"), 1)).alias("dates"),
    )
    rows = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("long")).alias("row_id"),
        F.array(F.col("l_orderkey").cast("string")).alias("numbers"),
        F.array(F.col("l_suppkey").cast("string")).alias("words"),
        F.array(day("l_shipdate")).alias("dates"),
    )
    rows = rows.dropDuplicates(["row_id"])
    return linkage.registry_matches(o, rows, "o_orderkey", "row_id")


def best_first_links(spark: SparkSession, sf: str) -> DataFrame:
    """Orders lead to their parts, parts to the orders they stand in: a walk of bounded budget from every order."""
    lines = table(spark, sf, "lineitem")
    o, p = F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey")
    score, place = F.col("l_quantity").cast("long"), (F.col("l_linenumber") + 10 * (F.col("l_orderkey") % 1000)).cast("long")
    out = lines.select(o.alias("page"), p.alias("url"), score.alias("score"), place.alias("position"))
    back = lines.select(p.alias("page"), o.alias("url"), score.alias("score"), place.alias("position"))
    first = table(spark, sf, "orders").select(F.col("o_orderkey").alias("notice"), F.concat(F.lit("o"), "o_orderkey").alias("url"))
    start = linkage.seeds([first], "notice")
    return linkage.best_first(start, out.unionByName(back), checkpointed(spark))


def state_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a state table, the second made from the first, read back."""
    root = _shared(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", day("o_orderdate").alias("seen_on"))
    state_store.commit(spark, root, {"notices": o.filter("o_orderkey % 2 = 0")})
    before = state_store.load(spark, root, "notices", o.schema)
    state_store.commit(spark, root, {"notices": before.unionByName(o.filter("o_orderkey % 2 = 1"))})
    return state_store.load(spark, root, "notices", o.schema)


STATE_ROUNDTRIP = "SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS seen_on FROM orders"


def incremental_state(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrive in four files, one batch each, give the same index as all at once."""
    root = _shared(spark)
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(f"{root}/arrivals")
    found = incremental.run(spark, f"{root}/arrivals", f"{root}/state", events.schema)
    return found.select("user_id", F.to_date("first_ts").alias("first_seen"), F.to_date("last_ts").alias("last_seen"), "n_seen", "status")


NEXT_DAY = "1998-06-10"


def incremental_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two daily snapshots of orders that arrive one after the other, each brought into the state by a run of its own."""
    root = _shared(spark)
    details = lambda due: due.filter(F.col("source_url") % 3 == 0).select("source_url", F.upper("title").alias("title"), "registration_end")
    for which, as_of in enumerate((AS_OF, NEXT_DAY)):
        cards = listing(spark, sf, which).withColumn("seen_on", F.lit(as_of).cast("date"))
        cards.write.mode("append").parquet(f"{root}/arrivals")
        found = incremental.run_snapshots(spark, f"{root}/arrivals", f"{root}/state", cards.schema, details)
    listed = found["seen"].select("source_url", F.col("last_seen").alias("listed_on"), F.col("status").alias("seen_status"))
    return found["notices"].join(listed.hint("merge"), "source_url").select(
        "source_url", "title", "registration_end", "first_seen", "last_seen", "updated_at", "status", "listed_on", "seen_status"
    )


INCREMENTAL_RUN = f"""WITH {BEFORE}, {NOW}, c AS (
  SELECT coalesce(n.source_url, b.source_url) AS k, b.source_url IS NOT NULL AS known, n.source_url IS NOT NULL AS listed, b.title AS bt, n.title AS nt,
    b.registration_end AS be, n.registration_end AS ne, b.listing_fingerprint IS DISTINCT FROM n.listing_fingerprint AS differs,
    DATE '{AS_OF}' AS a, DATE '{NEXT_DAY}' AS d FROM before b FULL JOIN now_ n USING (source_url)),
r AS (SELECT *, listed AND (NOT known OR differs OR (NOT coalesce(be < a, false)
    AND d - a >= CASE WHEN ne - d BETWEEN 0 AND {policy.RECHECK_CLOSING_DAYS} THEN 1 ELSE {policy.RECHECK_DAYS} END)) AS due FROM c),
m AS (SELECT *, CASE WHEN due THEN nt ELSE bt END AS t, CASE WHEN due THEN ne ELSE be END AS e, CASE WHEN known AND due AND differs THEN d END AS u FROM r),
s AS (SELECT *, CASE WHEN e < d THEN 'CLOSED' WHEN u IS NOT NULL THEN 'UPDATED' WHEN NOT known THEN 'NEW'
    WHEN e - d BETWEEN 0 AND {policy.CLOSING_DAYS} THEN 'CLOSING_SOON' WHEN e IS NOT NULL THEN 'OPEN' ELSE 'UNCERTAIN' END AS status FROM m)
SELECT k AS source_url, CASE WHEN k % 3 = 0 THEN upper(t) ELSE t END AS title, e AS registration_end, CASE WHEN known THEN a ELSE d END AS first_seen,
  CASE WHEN due THEN d ELSE a END AS last_seen, u AS updated_at, status, CASE WHEN listed THEN d ELSE a END AS listed_on, status AS seen_status FROM s"""


def card_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders rendered as a listing's cards, one listing for each customer, and read back."""
    d = day("o_orderdate")
    card = F.concat(
        F.lit('<div class="na"><div class="ca"><a href="/noticias/'), F.col("o_orderkey").cast("string"), F.lit('?x=1" title="T '), "o_orderpriority",
        F.lit('">Inst '), F.col("o_custkey").cast("string"), F.lit('</a><div class="cc">PR</div><div class="cd"><span>'), (F.col("o_orderkey") % 9 + 1).cast("string"),
        F.lit(" vagas até R$ 10,00</span><br>Professor Adjunto</div><div class=\"ce\">até "), F.date_format(d, "dd/MM/yyyy"), F.lit("</div></div></div>"),
    )
    rendered = table(spark, sf, "orders").select("o_custkey", "o_orderkey", card.alias("card"))
    listing = rendered.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "card"))), lambda x: x["card"]), "\n").alias("html"))
    found = pages.cards(listing, "o_custkey", "html", F.lit("https://site.example.org/list/"), F.lit(AS_OF).cast("date"))
    return found.select("o_custkey", "source_url", "title", "institution", "state", "position", "salary_text", "registration_end", "vacancies_count", F.length("id").alias("id_length"))


CARD_INGEST = """SELECT o_custkey, 'https://site.example.org/noticias/' || o_orderkey AS source_url, 'T ' || o_orderpriority AS title, 'Inst ' || o_custkey AS institution, 'PR' AS state,
  'Professor Adjunto' AS position, (o_orderkey % 9 + 1) || ' vagas até R$ 10,00' AS salary_text, o_orderdate::DATE AS registration_end, (o_orderkey % 9 + 1)::INT AS vacancies_count, 20 AS id_length FROM orders"""


def html_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order rendered as a table of areas and requirements, and read back."""
    row = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td> area "), F.col("l_partkey").cast("string"), F.lit(" </td><td>req &amp; "), "l_returnflag", F.lit("</td></tr>"))
    lines = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), "l_orderkey").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_returnflag", row.alias("t")).alias("x"))
    body = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("rows"))
    html = body.select("l_orderkey", F.concat(F.lit("<table><tr><th>Nº</th><th>Área</th><th>Requisitos</th></tr>"), "rows", F.lit("</table><table><tr><td>x</td></tr></table>")).alias("html"))
    return pages.table_records(pages.cells(html, "l_orderkey", "html"), "l_orderkey", {"area": "área|cargo", "requirement": "requisito"}).select("l_orderkey", "row", "area", "requirement")


HTML_TABLE_ROWS = """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag)::INT AS row, 'area ' || l_partkey AS area,
  'req & ' || l_returnflag AS requirement FROM lineitem"""


def area_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as blocks of text over several pages: a heading, a marker, and what follows."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_quantity").cast("int").alias("n"))
    body = F.concat(F.lit("ÁREA: "), F.col("part").cast("string"), F.lit("\nRequisitos: grau "), F.col("n").cast("string"), F.lit("\n"), F.col("n").cast("string"), F.lit(" vagas"))
    rows = segments.lines(lines.select("l_orderkey", F.col("l_linenumber").alias("page"), body.alias("t")), ["l_orderkey", "page"], "t")
    found = segments.blocks(rows, ["l_orderkey"], ["page", "line_no"], F.col("line").startswith("ÁREA:"))
    texts = segments.block_texts(found, ["l_orderkey"], ["page", "line_no"], "line", ["page"])
    return texts.select(
        "l_orderkey", "page", F.regexp_extract("text", r"ÁREA: (\S+)", 1).alias("area"), F.regexp_extract("text", r"Requisitos: ([^\n]+)", 1).alias("requirement"), text.vacancies(F.col("text")).alias("vacancies")
    )


AREA_BLOCKS = """SELECT l_orderkey, l_linenumber AS page, max(l_partkey)::VARCHAR AS area, 'grau ' || max(l_quantity)::INT AS requirement, max(l_quantity)::INT AS vacancies
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def field_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts, workload and counts written into a sentence, and read back."""
    k = F.col("p_partkey")
    amount = F.concat(F.lit("R$ "), (k % 900 + 100).cast("string"), F.lit(",50"))
    body = F.concat(amount, F.lit(" ou "), amount, F.lit(" e R$ 1.200,00 para "), (k % 30 + 10).cast("string"), F.lit(" horas semanais, "), "p_size", F.lit(" vagas"))
    return table(spark, sf, "part").select("p_partkey", text.money(body).alias("money"), text.workload(body).alias("workload"), text.vacancies(body).alias("vacancies"))


FIELD_EXTRACTION = """SELECT p_partkey, 'R$ ' || (p_partkey % 900 + 100) || ',50 a R$ 1.200,00' AS money, (p_partkey % 30 + 10) || ' horas semanais' AS workload, p_size AS vacancies FROM part"""


def evidence_scope(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as evidence with an overlap and a cue."""
    e = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_partkey") % 4).alias("overlap"), (F.max("l_suppkey") % 2 == 0).alias("cued"))
    return segments.scoped_evidence(e, ["l_orderkey"], "overlap", "cued", "l_linenumber", F.col("l_orderkey") % 2 == 0).select("l_orderkey", "l_linenumber", "confidence")


EVIDENCE_SCOPE = """WITH e AS (SELECT l_orderkey, l_linenumber, max(l_partkey) % 4 AS s, max(l_suppkey) % 2 = 0 AS c FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, max(s) OVER w AS best, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY l_orderkey)),
k AS (SELECT * FROM b WHERE best = 0 OR s >= greatest(1, best - 1)),
q AS (SELECT *, bool_or(c) OVER (PARTITION BY l_orderkey) AS any_cue FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber) AS r FROM q WHERE NOT any_cue OR c OR best = 0)
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 1 AND n > 3 THEN 'AMBIGUOUS' WHEN best >= 2 THEN 'HIGH' WHEN best = 1 THEN 'MEDIUM' WHEN n <= 3 THEN 'MEDIUM'
  ELSE 'AMBIGUOUS' END AS confidence FROM f WHERE r <= 10"""

QUERIES = {
    "normalised_fingerprint": (normalised_fingerprint, NORMALISED_FINGERPRINT),
    "canonical_pages": (canonical_pages, CANONICAL_PAGES),
    "page_links": (page_links, PAGE_LINKS),
    "link_top_k": (link_top_k, LINK_TOP_K),
    "page_text": (page_text, PAGE_TEXT),
    "date_mentions": (date_mentions, DATE_MENTIONS),
    "window_choice": (window_choice, WINDOW_CHOICE),
    "interval_check": (interval_check, INTERVAL_CHECK),
    "marker_runs": (marker_runs, MARKER_RUNS),
    "requirement_fields": (requirement_fields, REQUIREMENT_FIELDS),
    "evidence_windows": (evidence_windows, EVIDENCE_WINDOWS),
    "evidence_scope": (evidence_scope, EVIDENCE_SCOPE),
    "marker_blocks": (marker_blocks, MARKER_BLOCKS),
    "heading_carry_down": (heading_carry_down, HEADING_CARRY_DOWN),
    "best_extractor": (best_extractor, BEST_EXTRACTOR),
    "id_match": (id_match, ID_MATCH),
    "id_match_all": (id_match_all, ID_MATCH_ALL),
    "token_overlap": (token_overlap, TOKEN_OVERLAP),
    "token_overlap_all": (token_overlap_all, TOKEN_OVERLAP_ALL),
    "registry_match": (registry_match, None),
    "best_first_links": (best_first_links, None),
    "state_roundtrip": (state_roundtrip, STATE_ROUNDTRIP),
    "incremental_state": (incremental_state, SEEN_INDEX),
    "incremental_run": (incremental_run, INCREMENTAL_RUN),
    "card_ingest": (card_ingest, CARD_INGEST),
    "html_table_rows": (html_table_rows, HTML_TABLE_ROWS),
    "area_blocks": (area_blocks, AREA_BLOCKS),
    "field_extraction": (field_extraction, FIELD_EXTRACTION),
}
