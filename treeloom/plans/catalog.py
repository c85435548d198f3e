"""Queries over the supplied tables, one for each operator they can exercise, and the same in DuckDB's SQL.

Orders stand for commits and parts for paths, documents and pages for files, link targets for dependencies, events for the ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..operators import graph as G
from ..operators import history as H
from ..operators import ledger as L
from ..operators import text as T
from ..streaming import watch as W

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))


def links(spark: SparkSession, d: str) -> DataFrame:
    hrefs = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))))
    return t(spark, d, "pages").select("page_id", hrefs.alias("href"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).select(F.col("page_id").alias("src"), F.col("href").alias("dst"))


CF = "SELECT DISTINCT l_orderkey AS c, l_partkey AS p FROM lineitem"
CHURN = f"SELECT p, count(*) AS commits FROM ({CF}) GROUP BY p"
LINKS = """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages"""


@query(f"SELECT p AS path, commits FROM ({CHURN})")
def churn(spark, d):
    return H.churn(commit_files(spark, d))


@query(f"""SELECT p AS path, commits, dependents, commits * (1 + dependents) AS score FROM ({CHURN})
JOIN (SELECT l_partkey AS p, count(DISTINCT l_suppkey) AS dependents FROM lineitem GROUP BY 1) USING (p)
ORDER BY score DESC, commits DESC, dependents DESC, path LIMIT 10""")
def hotspots(spark, d):
    dependents = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.count_distinct("l_suppkey").alias("dependents"))
    return H.hotspots(H.churn(commit_files(spark, d)), dependents)


@query(f"""WITH c AS ({CHURN}), v AS (SELECT list_sort(list(commits), 'DESC') AS l, count(*) AS n FROM c)
SELECT p AS path, commits, greatest(3, CASE WHEN n >= 10 THEN l[n // 10 + 1] ELSE l[1] END)::BIGINT AS threshold,
commits >= greatest(3, CASE WHEN n >= 10 THEN l[n // 10 + 1] ELSE l[1] END) AS hotspot FROM c, v""")
def hotspot_flag(spark, d):
    return H.hotspot_flags(H.churn(commit_files(spark, d)))


@query(f"""SELECT b.p AS path, count(*) AS co_changes FROM ({CF}) a JOIN ({CF}) b ON a.c = b.c AND a.p <> b.p
WHERE a.p = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def neighbors(spark, d):
    return H.neighbors(commit_files(spark, d), 1)


@query(f"""SELECT a.p AS a, b.p AS b, count(*) AS co_changes FROM ({CF}) a JOIN ({CF}) b ON a.c = b.c AND a.p < b.p
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100""")
def cochange_pairs(spark, d):
    return H.cochange(commit_files(spark, d), 100)


@query("""SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS commits FROM lineitem WHERE l_orderkey IN
(SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 2000) GROUP BY 1""")
def max_commits_window(spark, d):
    newest = H.latest(t(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts")))
    return H.churn(commit_files(spark, d).join(newest, "commit", "left_semi"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
h AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM l WHERE contains(text, 'tion'))
SELECT doc_id, line, text, total FROM h WHERE n <= 5""")
def search_lines(spark, d):
    return T.search(T.line_table(t(spark, d, "documents"), "doc_id"), "tion", 5, "doc_id")


TOKENS = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END"


@query(f"SELECT source, sum({TOKENS})::BIGINT AS raw_tokens, count(*) AS files FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def budget(spark, d):
    per = t(spark, d, "documents").groupBy(F.col("source").alias("path")).agg(F.sum(S.tokens(F.col("text"))).alias("raw_tokens"), F.count("*").alias("dependents"))
    return T.largest(per.withColumn("symbols", F.lit(0))).select(F.col("path").alias("source"), "raw_tokens", F.col("dependents").alias("files"))


@query("SELECT lang, count(*) AS files, rank() OVER (ORDER BY count(*) DESC, lang) = 1 AS is_primary FROM documents GROUP BY lang")
def language_map(spark, d):
    return T.histogram(t(spark, d, "documents"), "lang")


@query("""SELECT d.doc_id, coalesce(l.n, 0) AS labelled, d.n_chars FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id) ORDER BY 2 DESC, 3, 1 LIMIT 20""")
def important_docs(spark, d):
    per = t(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    facts = t(spark, d, "documents").join(per, "doc_id", "left").select(F.col("doc_id").alias("path"), F.coalesce("n", F.lit(0)).alias("dependents"), F.lit(0).alias("symbols"), F.col("n_chars").alias("lines"))
    return T.important(facts).select(F.col("path").alias("doc_id"), F.col("dependents").alias("labelled"), F.col("lines").alias("n_chars"))


def _sql_pattern(p: str) -> str:
    return p.replace("'", "''")


def _matches(pattern: str) -> str:
    return f"regexp_matches(text, '{_sql_pattern(pattern)}')"


@query(" UNION ALL ".join([f"SELECT doc_id, '{label}' AS finding FROM documents WHERE {_matches(p)}" for p, label in C.FINDINGS] + [f"SELECT doc_id, '{C.RANDOMNESS[2]}' FROM documents WHERE {_matches(C.RANDOMNESS[0])} AND {_matches(C.RANDOMNESS[1])}"]))
def secret_findings(spark, d):
    """All rules over all documents."""
    return t(spark, d, "documents").select("doc_id", F.explode(S.findings(F.col("text"))).alias("finding"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{label}' AS effect FROM documents WHERE {_matches(p)}" for p, label in C.SIDE_EFFECTS))
def side_effects(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(S.side_effects(F.col("text"))).alias("effect"))


def _stripped(column: str, ext: str) -> str:
    parts = next(x for types, x in S.LEXEMES.items() if ext in types)
    return f"length(regexp_replace({column}, '{_sql_pattern(S.stripping(*parts))}', '\\1', 'g'))::BIGINT"


@query(f"""SELECT page_id AS id, 'page' AS kind, {_stripped('html', '.js')} AS chars FROM pages
UNION ALL SELECT doc_id, 'document', {_stripped('text', '.rb')} FROM documents""")
def comment_strip(spark, d):
    """Pages read as script, documents as a language with hash comments; strings stay whole."""
    left = lambda c, ext: F.length(S.without_comments(F.col(c), F.lit(ext))).cast("long").alias("chars")
    pages = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), left("html", ".js"))
    return pages.unionByName(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), left("text", ".rb")))


@query(f"SELECT href, count(*) AS dependents FROM ({LINKS}) GROUP BY 1")
def dependents(spark, d):
    return G.dependents(edges(spark, d)).select(F.col("path").alias("href"), "dependents")


@query(f"SELECT href, array_to_string(list_sort(list(page_id)), ',') AS pages FROM ({LINKS}) GROUP BY 1")
def inverse_deps(spark, d):
    return G.inverse(edges(spark, d)).select(F.col("path").alias("href"), F.array_join("dependent_paths", ",").alias("pages"))


@query("""WITH p AS (SELECT page_id, url, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages),
s AS (SELECT page_id, url, array_to_string(parts, '/') AS at, array_to_string(parts[i:], '/') AS suffix FROM p, range(1, 100) r(i) WHERE i <= len(parts)),
q AS (SELECT page_id AS src, parts[-1] AS probe FROM p)
SELECT src, probe, page_id AS resolved FROM (SELECT q.src, q.probe, s.page_id, row_number() OVER (PARTITION BY q.src ORDER BY (s.at <> s.suffix)::INT, length(s.url), s.url, s.page_id) AS n
FROM q JOIN s ON s.suffix = q.probe) WHERE n = 1""")
def suffix_resolve(spark, d):
    pages = t(spark, d, "pages").withColumn("at", F.regexp_replace("url", "^[a-z]+://", ""))
    best = G.suffix_index(pages, F.col("at"), F.col("page_id"), F.struct(F.length("url"), "url", "page_id"))
    probes = pages.select(F.col("page_id").alias("src"), F.element_at(F.split("at", "/"), -1).alias("probe"))
    return probes.join(best.withColumnRenamed("suffix", "probe"), "probe").select("src", "probe", F.col("dst").alias("resolved"))


@query("SELECT o_orderkey, o_orderstatus FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey")
def semi_callers(spark, d):
    scope = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"))
    return G.within(t(spark, d, "orders").withColumnRenamed("o_orderkey", "path"), scope).select(F.col("path").alias("o_orderkey"), "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1")
def anti_defs(spark, d):
    """Orders without a first line: orders stand for references on line 1, order lines for definitions."""
    refs = t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.lit(1).alias("line"), "o_orderstatus")
    return G.without(refs, t(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"))).select(F.col("path").alias("o_orderkey"), "o_orderstatus")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def tests_for_match(spark, d):
    """Containment through an equi-join on hashed windows, then the exact test."""
    bench = t(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    return T.holding(t(spark, d, "documents").select("doc_id", "text"), bench, part="item").select("item_id", "doc_id")


@query("""WITH a AS (SELECT l_partkey AS p, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey AS p, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' ELSE 'changed' END AS status, a.n AS "old", b.n AS "new"
FROM a FULL JOIN b ON a.p = b.p WHERE a.n IS DISTINCT FROM b.n""")
def snapshot_diff(spark, d):
    side = lambda s: t(spark, d, "lineitem").where(F.col("l_linestatus") == s).groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("n"))
    return T.snapshot_diff(side("F"), side("O"), ["path"], "n")


@query("""SELECT conv_id, role, n AS turns, (1000 * n // sum(n) OVER (PARTITION BY conv_id))::BIGINT AS per_mille
FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2)""")
def blame_share(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("role").alias("author"))
    return H.ownership(rows).select(F.col("path").alias("conv_id"), F.col("author").alias("role"), F.col("lines").alias("turns"), "per_mille")


@query("""SELECT o_orderkey, points, CASE WHEN points >= 5 THEN 'HIGH' WHEN points >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (
SELECT o_orderkey, (3 * (o_totalprice > 200000)::INT + 2 * (o_orderstatus = 'F')::INT + 2 * (o_orderpriority = '1-URGENT')::INT + least(3, coalesce(n, 0)) + 1 + (coalesce(n, 0) = 0)::INT)::BIGINT AS points
FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (o_orderkey))""")
def risk_points(spark, d):
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = t(spark, d, "orders").join(n, "o_orderkey", "left").fillna(0, ["n"])
    points = H.risk_points(F.col("o_totalprice") > 200000, (F.col("o_orderstatus") == "F").cast("long"), (F.col("o_orderpriority") == "1-URGENT").cast("long"), F.col("n"), F.lit(1), F.col("n"))
    return o.select("o_orderkey", points.alias("points")).withColumn("level", H.risk_level(F.col("points")))


@query(f"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '{C.TEST_ROLE}' {" ".join(f"WHEN {' OR '.join(f"contains(p, '{w}')" for w in words)} THEN '{label}'" for words, label in C.ROLES)} ELSE '{C.OTHER_ROLE}' END AS role
FROM (SELECT page_id, lower(url || CASE page_id % 5 WHEN 1 THEN '/Service' WHEN 2 THEN '/routes/db' WHEN 3 THEN '/Schema' ELSE '' END) AS p FROM pages)""")
def role_rules(spark, d):
    """Pages' addresses, some with a word of a role added; every seventh counts as a test."""
    word = F.when(F.col("page_id") % 5 == 1, "/Service").when(F.col("page_id") % 5 == 2, "/routes/db").when(F.col("page_id") % 5 == 3, "/Schema").otherwise("")
    return t(spark, d, "pages").select("page_id", S.role(F.concat("url", word), F.col("page_id") % 7 == 0).alias("role"))


@query("""SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS raw_tokens, sum(event_id // 3)::BIGINT AS output_tokens,
sum(event_id - event_id // 3)::BIGINT AS saved_tokens, (CASE WHEN sum(event_id) = 0 THEN 0 ELSE 1000 * sum(event_id - event_id // 3) // sum(event_id) END)::BIGINT AS saved_per_mille FROM (
SELECT *, row_number() OVER (PARTITION BY ts, user_id ORDER BY src, event_id) AS k FROM (SELECT *, 0 AS src FROM events UNION ALL SELECT *, 1 FROM events WHERE event_type = 'click')) WHERE k = 1 GROUP BY 1""")
def ledger_rollup(spark, d):
    e = t(spark, d, "events")
    both = e.withColumn("src", F.lit(0)).unionByName(e.where("event_type = 'click'").withColumn("src", F.lit(1)))
    third = F.floor(F.col("event_id") / 3).cast("long")
    rows = both.select("ts", F.col("user_id").alias("command"), F.col("src").alias("src_rank"), F.col("event_id").alias("raw_tokens"), third.alias("output_tokens"), (F.col("event_id") - third).alias("saved_tokens"), "event_type")
    return L.totals(L.once(rows, "raw_tokens"), "event_type").select("event_type", F.col("commands").alias("n"), "raw_tokens", "output_tokens", "saved_tokens", "saved_per_mille")


@query("""SELECT user_id, epoch_us(min(ts)) AS began_us, epoch_us(max(ts)) AS ended_us, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM (SELECT user_id, ts, event_type, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")
def session_debounce(spark, d):
    e = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"))
    bursts = W.debounced(e, "user_id", gap="30 minutes")
    return bursts.select("user_id", F.unix_micros("began").alias("began_us"), F.unix_micros("last").alias("ended_us"), F.col("events").alias("n"), F.array_join("paths", ",").alias("kinds"))


@query(f"""WITH RECURSIVE r AS (SELECT source, doc_id, {TOKENS} AS tokens, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
f AS (SELECT source, doc_id, tokens, k, true AS took, tokens AS used FROM r WHERE k = 1 UNION ALL
SELECT r.source, r.doc_id, r.tokens, r.k, f.used + r.tokens <= 20000, CASE WHEN f.used + r.tokens <= 20000 THEN f.used + r.tokens ELSE f.used END FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1)
SELECT source, doc_id, tokens::BIGINT AS tokens FROM f WHERE took""")
def budget_pack(spark, d):
    rows = t(spark, d, "documents").select("source", "doc_id", S.tokens(F.col("text")).alias("tokens"), (-F.col("n_chars")).alias("minus"))
    return T.greedy(rows, "source", ["minus", "doc_id"], "tokens", 20000).select("source", "doc_id", "tokens")


@query("SELECT c_custkey AS id, n_name AS nation, r_name AS region, 'in ' || r_name AS effects FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def chain_lookup(spark, d):
    """Customers stand for routes, their nations for handlers, those nations' regions for the classes that are called."""
    nations, regions = t(spark, d, "nation"), t(spark, d, "region")
    routes = t(spark, d, "customer").select(F.col("c_custkey").alias("route"), F.col("c_nationkey").alias("handler"))
    symbols = nations.select(F.col("n_name").alias("handler_path"), F.col("n_nationkey").alias("handler"))
    calls = nations.select(F.col("n_name").alias("handler_path"), F.col("n_nationkey").alias("handler"), F.col("n_regionkey").alias("class_name"), F.lit("of").alias("method_name"), F.lit(False).alias("inferred"))
    classes = regions.select(F.col("r_regionkey").alias("class_name"), F.col("r_name").alias("class_path"), F.array(F.lit("of")).alias("methods"))
    effects = regions.select(F.col("r_name").alias("class_path"), F.array(F.concat(F.lit("in "), "r_name")).alias("side_effects"))
    chain = G.call_chain(routes, symbols, calls, classes, effects)
    return chain.select(F.col("route").alias("id"), F.col("handler_path").alias("nation"), F.col("class_path").alias("region"), F.array_join("side_effects", ",").alias("effects"))


@query("""SELECT doc_id, total, n AS per_source_rank FROM (SELECT doc_id, count(*) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 5""")
def hits_per_file(spark, d):
    """The five longest documents of each source and the source's count; only the top rows are windowed."""
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return T.first_of_each(docs, "source", [F.desc("n_chars"), "doc_id"], 5).select("doc_id", "total", F.col("place").cast("long").alias("per_source_rank"))


@query("SELECT doc_id, CASE WHEN n = 0 THEN NULL ELSE n END AS lines, length(text)::BIGINT AS chars FROM (SELECT doc_id, text, len(string_split(text, chr(10))) - (text LIKE '%' || chr(10) OR text = '')::INT AS n FROM documents)")
def line_counts(spark, d):
    """Lines of whole documents as the line table has them; only line feeds part lines in these tables."""
    docs = t(spark, d, "documents")
    per = T.line_table(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"))
    return docs.join(per, "doc_id", "left").select("doc_id", "lines", F.length("text").cast("long").alias("chars"))


@query("""SELECT path, risk, blast FROM (SELECT url AS path, d, h, CASE WHEN h OR d > 3 OR regexp_matches(lower(url), 'auth|db|session|payment') THEN 'HIGH' WHEN d > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
CASE WHEN h OR d > 5 OR regexp_matches(lower(url), 'auth|db|session|payment|billing') THEN 'HIGH' WHEN d > 0 THEN 'MEDIUM' ELSE 'LOW' END AS blast FROM (SELECT url, page_id % 8 AS d, page_id % 13 = 0 AS h FROM pages))""")
def impact_rules(spark, d):
    """The verdicts of impact and preflight over pages' addresses, with dependents and hotspots made from their numbers."""
    n, hot = F.col("page_id") % 8, F.col("page_id") % 13 == 0
    return t(spark, d, "pages").select(F.col("url").alias("path"), H.impact_risk(F.col("url"), n, hot).alias("risk"), H.blast_radius(F.col("url"), n, hot).alias("blast"))


@query("""SELECT path, array_to_string(list_sort(list(DISTINCT path || '>' || href)), ',') AS shown FROM (SELECT page_id AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) WHERE path % 20 = 0 GROUP BY 1""")
def related_paths(spark, d):
    """Link targets of every twentieth page, through the edge list turned round."""
    turned = edges(spark, d).where("src % 20 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.inverse(turned).select("path", F.array_join(F.transform("dependent_paths", lambda x: F.concat(F.col("path").cast("string"), F.lit(">"), x)), ",").alias("shown"))


COMMANDS = ("cat a.py", "head -5 src/b.ts", "tail -f a.py", "cat a.py b.py", "grep foo", "rg 'a b'", "grep -r foo", "find .", "tree", "git status", "git diff", "git log", "pytest -q", "npm test", "go test ./...", "ls -la", "cat a.py | wc", "cat notes.txt", "!raw cat a.py", "")


@query()
def rewrite_policy(spark, d):
    """The command policy over the events, each with one of the commands; rows only: quoting rules are no SQL."""
    which = F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("event_id") % len(COMMANDS) + 1).cast("int"))
    commands = L.rewritten(t(spark, d, "events").select(which.alias("command"))).groupBy("command", "rewritten").agg(F.count("*").alias("n"))
    return commands.withColumn("analogue", L.raw_analogue(F.col("rewritten"))).withColumn("said", L.parsed(F.concat(F.lit("hook: "), "command", F.lit(" -> "), F.coalesce("rewritten", F.lit("")))))


@query(f"SELECT doc_id, {TOKENS}::BIGINT AS raw_tokens, (length(lang) // 4 + (length(lang) BETWEEN 1 AND 3)::INT)::BIGINT AS output_tokens FROM documents")
def savings(spark, d):
    """What a document would cost raw, and what its language name costs."""
    outputs = t(spark, d, "documents").select(F.col("doc_id").alias("command"), F.col("text").alias("raw"), F.col("lang").alias("compact"))
    return L.savings(outputs).select(F.col("command").alias("doc_id"), "raw_tokens", "output_tokens")


@query("""SELECT lower(event_type) AS state, count(*) AS files FROM events GROUP BY 1""")
def status_counts(spark, d):
    from ..sources import git

    return git.status_counts(t(spark, d, "events").select(F.lower("event_type").alias("state"), F.col("event_id").alias("path")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
