"""Names and texts: canonical forms, aliases, redaction, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulequarry.functions import text as T
from rulequarry.operators import aliases
from rulequarry.plans.registry import query
from rulequarry.sources.views import spread, table

_CANON = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '([._-]v?[0-9]+(\.[0-9]+)*)+$', ''), '[\s._-]+', '_', 'g'), '^_+|_+$', '', 'g')"
_ALL = "SELECT p_brand AS name FROM part UNION SELECT replace(p_name, ' ', '-') || '_v' || CAST(p_size % 3 AS VARCHAR) FROM part UNION SELECT n_name FROM nation UNION SELECT s_name FROM supplier"
_FORMS = f"WITH RECURSIVE raw AS ({_ALL}), r AS (SELECT row_number() OVER (ORDER BY name) AS id, name, {_CANON.format('name')} AS form FROM raw)"


def _names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    out = part.select(F.col("p_brand").alias("name")).union(part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_v"), (F.col("p_size") % 3).cast("string"))))
    return out.union(table(spark, sf_dir, "nation").select("n_name")).union(table(spark, sf_dir, "supplier").select("s_name"))


@query(f"{_FORMS} SELECT name, form FROM r")
def canonical_form(spark, sf_dir):
    return aliases.forms(_names(spark, sf_dir)).select("name", "form")


_TOK = "list_distinct(list_filter(string_split({0}, '_'), lambda t: t <> ''))"
_TRI = "[('  ' || {0} || '  ')[i:i + 2] FOR i IN range(1, length({0}) + 3)]"
_PAIRS = f"""{_FORMS}, t AS (SELECT id, name, form, {_TOK.format('form')} AS tok FROM r),
g AS (SELECT id, unnest({_TRI.format('form')}) AS g FROM r), gc AS (SELECT id, g, count(*) AS c FROM g GROUP BY ALL), gn AS (SELECT id, sum(c * c) AS nn FROM gc GROUP BY id),
dot AS (SELECT x.id AS a, y.id AS b, sum(x.c * y.c) AS d FROM gc x JOIN gc y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
p AS (SELECT x.id AS a, y.id AS b, x.form = y.form AS same, CASE WHEN len(list_distinct(x.tok || y.tok)) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(x.tok, y.tok)) / CAST(len(list_distinct(x.tok || y.tok)) AS DOUBLE) END AS jaccard,
  CAST(least(3, levenshtein(x.form, y.form)) AS INTEGER) AS distance, round(coalesce((SELECT d FROM dot WHERE dot.a = x.id AND dot.b = y.id), 0) / sqrt(CAST((SELECT nn FROM gn WHERE gn.id = x.id) AS DOUBLE) * (SELECT nn FROM gn WHERE gn.id = y.id)), 6) AS cosine
  FROM t x JOIN t y ON x.id < y.id), k AS (SELECT * FROM p WHERE same OR jaccard >= 0.5 OR distance <= 2 OR cosine >= 0.78)"""


@query(f"{_PAIRS} SELECT a, b, same, jaccard, distance, cosine FROM k")
def alias_pairs(spark, sf_dir):
    return aliases.pairs(aliases.forms(_names(spark, sf_dir))).select("a", "b", "same", "jaccard", "distance", "cosine")


_CL = f"""{_PAIRS}, e AS (SELECT a, b FROM k UNION SELECT b, a FROM k), lab AS (SELECT id AS x, id AS y FROM r UNION SELECT lab.x, e.b FROM lab JOIN e ON e.a = lab.y),
c AS (SELECT x AS id, min(y) AS cluster FROM lab GROUP BY x), h AS (SELECT cluster, arg_min(form, (length(form), form, name)) AS canonical FROM c JOIN r USING (id) GROUP BY cluster)"""


@query(f"{_CL} SELECT name, form, canonical FROM r JOIN c USING (id) JOIN h USING (cluster)")
def alias_clusters(spark, sf_dir):
    rows = aliases.forms(_names(spark, sf_dir))
    return aliases.clusters(rows, aliases.links(rows))


_COUNTS = "list_sum([CAST(len(list_filter({0}, lambda t: t = g)) * len(list_filter({1}, lambda t: t = g)) AS DOUBLE) FOR g IN list_distinct({0})])"


@query(f"""{_CL}, d AS (SELECT name, form, canonical, CAST(least(3, levenshtein(form, canonical)) AS INTEGER) AS distance, {_TOK.format('form')} AS x, {_TOK.format('canonical')} AS y, {_TRI.format('form')} AS gx, {_TRI.format('canonical')} AS gy FROM r JOIN c USING (id) JOIN h USING (cluster)),
j AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE) END AS jaccard,
  {_COUNTS.format('gx', 'gy')} / sqrt({_COUNTS.format('gx', 'gx')} * {_COUNTS.format('gy', 'gy')}) AS cosine FROM d)
SELECT name, canonical, CASE WHEN name = canonical THEN 'self' WHEN form = canonical THEN 'exact' WHEN distance <= 2 THEN 'edit_distance' WHEN jaccard >= 0.5 THEN 'token_jaccard' ELSE 'trigram_cosine' END AS method,
  CASE WHEN name = canonical THEN CAST(1 AS DOUBLE) WHEN form = canonical THEN CAST(0.99 AS DOUBLE) WHEN distance <= 2 THEN 1 - distance / CAST(4 AS DOUBLE) WHEN jaccard >= 0.5 THEN round(jaccard, 3) ELSE round(cosine, 3) END AS confidence FROM j""")
def alias_decisions(spark, sf_dir):
    """How each name came to its canonical form, and how certain that is."""
    return aliases.decisions(alias_clusters(spark, sf_dir))


@query(f"""{_FORMS.replace('WITH RECURSIVE', 'WITH')} SELECT x.name AS a, y.name AS b, CAST(least(4, levenshtein(x.form, y.form)) AS INTEGER) AS distance FROM r x JOIN r y ON x.id < y.id AND y.id <= x.id + 3""")
def levenshtein_bounded(spark, sf_dir):
    rows = aliases.forms(_names(spark, sf_dir))
    other = rows.select(F.explode(F.array(F.col("id") - 1, F.col("id") - 2, F.col("id") - 3)).alias("id"), F.col("name").alias("b"), F.col("form").alias("fb"))
    return rows.join(other, "id").select(F.col("name").alias("a"), "b", T.levenshtein_bounded("form", "fb", 3).alias("distance"))


_CLEAN = "text"
for _name, _pattern in (
    ("email", "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"),
    ("credit_card", "([0-9][ -]?){13,19}"),
    ("ssn", "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b"),
    ("api_token", "\\b(sk|pk|ghp|ls)_[A-Za-z0-9_]{16,}\\b|\\bAKIA[0-9A-Z]{16}\\b"),
    ("jwt", "\\beyJ[A-Za-z0-9_-]+?\\.[A-Za-z0-9_-]+?\\.[A-Za-z0-9_-]+\\b"),
    ("phone", "\\+?[0-9]{1,3}[ -.]?\\(?[0-9]{2,4}\\)?[ -.]?[0-9]{3,4}[ -.]?[0-9]{3,4}"),
    ("ipv4", "\\b([0-9]{1,3}\\.){3}[0-9]{1,3}\\b"),
    ("ipv6", "\\b([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\\b"),
    ("iban", "\\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\\b"),
):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '[redacted:{_name}]', 'g')"


@query(f"SELECT doc_id, md5(clean) AS digest, contains(clean, '[redacted:') AS changed FROM (SELECT doc_id, {_CLEAN} AS clean FROM documents)")
def redact_text(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", T.redact_text("text").alias("clean"))
    return docs.select("doc_id", F.md5("clean").alias("digest"), F.contains("clean", F.lit("[redacted:")).alias("changed"))


#: Detectors of the query below: upper-case words with capitalised ones behind, two capitalised words, long numbers.
_DETECTORS = (("ORG", "[A-Z]{2,}( [A-Z][a-z]+)+"), ("NAME", "[A-Z][a-z]+ [A-Z][a-z]+"), ("NUMBER", "[0-9]{3,}"))


def _spans_sql(rank: int, pattern: str) -> str:
    """Rows of a detector: where each match starts is what lies before it, pieces and matches."""
    return f"""SELECT doc_id, {rank} AS rank, m[i] AS content, CAST(coalesce(list_sum([length(g) FOR g IN p[:i]]), 0) + coalesce(list_sum([length(g) FOR g IN m[:i - 1]]), 0) AS INTEGER) AS start
    FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM documents))"""


_SPANS = " UNION ALL ".join(_spans_sql(k, p) for k, (_, p) in enumerate(_DETECTORS))


@query(f"""WITH s AS ({_SPANS}), o AS (SELECT doc_id, list(content ORDER BY -length(content), start, rank) AS contents, list(rank ORDER BY -length(content), start, rank) AS ranks FROM s GROUP BY doc_id),
r AS (SELECT doc_id, CASE WHEN contents IS NULL THEN text ELSE list_reduce([text] || list_transform(list_zip(contents, ranks), lambda z: CAST(z[2] AS VARCHAR) || z[1]), lambda a, b: CASE WHEN contains(a, b[2:])
  THEN a[:strpos(a, b[2:]) - 1] || '[redacted:' || {"CASE b[1:1] " + " ".join(f"WHEN '{k}' THEN '{label.lower()}'" for k, (label, _) in enumerate(_DETECTORS)) + " END"} || ']' || a[strpos(a, b[2:]) + length(b) - 1:] ELSE a END) END AS clean, coalesce(len(contents), 0) AS n_spans FROM documents LEFT JOIN o USING (doc_id))
SELECT doc_id, CAST(n_spans AS INTEGER) AS n_spans, md5(clean) AS digest FROM r""")
def redact_spans(spark, sf_dir):
    """Spans of three detectors, of which two overlap, masked the longest first in every document."""
    found = [T.spans("text", pattern, label) for label, pattern in _DETECTORS]
    docs = spread(table(spark, sf_dir, "documents"))
    n = sum((F.coalesce(F.size(f), F.lit(0)) for f in found), F.lit(0))
    return docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("int").alias("n_spans"), F.md5(T.redact_spans("text", *found)).alias("digest"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g')) AS key FROM benchmark")
def dedup_key(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.dedup_key("text").alias("key"))


@query("SELECT p_partkey, substr(regexp_replace('inv-' || md5(CAST(p_partkey AS VARCHAR)), '^inv-', ''), 1, 8) AS short_id FROM part")
def short_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.short_id(F.concat(F.lit("inv-"), F.md5(F.col("p_partkey").cast("string")))).alias("short_id"))


@query("""SELECT s_suppkey, CASE WHEN regexp_matches(s_name, '[:#\n"'']') THEN '"' || replace(s_name, '"', '\\"') || '"' ELSE s_name END AS escaped FROM supplier""")
def yaml_escape(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.yaml_escape("s_name").alias("escaped"))


@query("SELECT c_custkey, sha256('ls_' || c_name) AS hash FROM customer")
def api_key_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.api_key_hash(F.concat(F.lit("ls_"), "c_name")).alias("hash"))


@query("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE sha256('ls_' || c_name) IN (SELECT sha256('ls_' || c_name) FROM customer WHERE c_custkey % 50 = 0) AND n.n_regionkey <> 2")
def api_key_lookup(spark, sf_dir):
    """Keys presented, found by their hash, unless revoked."""
    known = table(spark, sf_dir, "customer").withColumn("hash", T.api_key_hash(F.concat(F.lit("ls_"), "c_name")))
    given = known.filter("c_custkey % 50 = 0").select("hash").distinct()
    owner = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return known.join(given, "hash", "left_semi").join(F.broadcast(owner), "c_nationkey").select("c_custkey", "n_name")
