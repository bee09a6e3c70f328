"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triloom.llm import op01_quality, op02_url_filter, op03_exact_dedup, op04_language_id, op05_mixing, op06_license_scan, op07_embedding_dedup, op08_minhash_dedup, op09_packing, op11_phrases, op12_pii, op13_vector_codes
from triloom.llm import op10_sharding as sharding
from triloom.llm.common import A_Z, a_z, read

R = op02_url_filter.Rule
URL_RULES = [R("allow", "org", "/"), R("block", "example.org", "/es/"), R("block", "example.org", "/en/1"), R("allow", "com", "/fr/"), R("block", "com", "/de/")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_quality.quality_of_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_url_filter.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_exact_dedup.duplicates(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_language_id.language_of_documents(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_mixing.mix(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_license_scan.scan(read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=4)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_packing.pack_documents(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), sharding.grid(40))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_phrases.collocations(read(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_pii.personal_data(read(spark, sf_dir, "documents"))


def op13_vector_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality,
            op2_url_filter,
            op3_exact_dedup,
            op4_language_id,
            op5_mixing,
            op6_license_scan,
            op7_embedding_dedup,
            op8_minhash_dedup,
            op9_packing,
            op10_sharding,
            op11_collocations,
            op12_personal_data,
            op13_vector_compression,
        )
    }


def _url_sql() -> str:
    ranked = sorted(URL_RULES, key=lambda r: (-len(r.text), r.verdict != "allow", r.text))

    def case(value: str) -> str:
        when = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'" for r in ranked)
        return f"CASE {when} END"

    def split(url: str) -> str:
        rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
        return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{A_Z}', '{a_z}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"

    # Expresses the rules and the default; the tables hold no redirect or canonical link, whose
    # classes are tested against brute force.
    return f"""WITH p AS (SELECT page_id, {split("coalesce(url, '')")} FROM pages)
SELECT page_id, host, path, {case("text")} AS rule, coalesce({case("verdict")}, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS component FROM p"""


def _phrase_sql(longest: int = 5, least: int = 100, top: int = 2000) -> str:
    """Brute force: every stretch of words of every piece."""
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{A_Z}', '{a_z}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS ph FROM w, range(1, {longest + 1}) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {least}),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
i AS (SELECT lang, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda s: ph[s:s + m - 1])))) AS ph, f FROM f WHERE k > 2),
c AS (SELECT f.* FROM f LEFT JOIN (SELECT lang, ph, max(f) AS m FROM i GROUP BY ALL) x USING (lang, ph) WHERE k > 1 AND (m IS NULL OR 100 * m < 100 * f)),
u AS (SELECT c.lang, c.k, c.ph, c.f, h.f AS l, t.f AS r, n.n, s.s, CAST((1000::HUGEINT * c.f * n.n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
FROM c, range(1, {longest}) s(s) JOIN f h ON h.lang = c.lang AND h.ph = c.ph[1:s.s] JOIN f t ON t.lang = c.lang AND t.ph = c.ph[s.s + 1:] JOIN n ON n.lang = c.lang WHERE s.s < c.k),
b AS (SELECT lang, array_to_string(ph, ' ') AS phrase, f AS a, l, r, n, score FROM u QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, s) = 1)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY rank <= {top}"""


def _pii_sql() -> str:
    """The contract's patterns as they are, and all words of all texts with their places."""
    o = op12_pii
    runs = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    rows = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(patterns))
    low = f"translate({{}}, '{A_Z}', '{a_z}')"

    def near(side: str, cut: str) -> str:
        part = f"right({side}, {o.REACH})" if cut == "2:" else f"left({side}, {o.REACH})"
        words = f"regexp_split_to_array({low.format(part)}, '{o.GAPS}')"
        return f"list_filter(CASE WHEN length({side}) <= {o.REACH} THEN {words} ELSE {words}[{cut}] END, lambda x: {term('x')})"

    def term(x: str) -> str:
        return f"length({x}) BETWEEN {o.SHORTEST} AND {o.LONGEST_TERM} AND regexp_matches({x}, '[^0-9]')"

    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
pat(i, kind, p) AS (VALUES {rows}),
s AS (SELECT k, i, kind, t, regexp_extract_all(t, p) AS ms, regexp_split_to_array(t, p) AS gs FROM d, pat WHERE regexp_matches(t, p)),
u AS (SELECT k, i, kind, t, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(range(len(ms))) AS j FROM s),
e AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY k, i ORDER BY j) AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS nr FROM u),
c AS (SELECT *, stop - length(m) AS start, lag(stop, 1, 0) OVER w AS low, lead(stop - length(m), 1, length(t)) OVER w AS high FROM e WHERE kind <> 'card' OR length(nr) BETWEEN 13 AND 19 WINDOW w AS (PARTITION BY k, i ORDER BY j)),
v AS (SELECT *, substr(t, CAST(low AS BIGINT) + 1, CAST(start - low AS BIGINT)) AS l, substr(t, CAST(stop AS BIGINT) + 1, CAST(high - stop AS BIGINT)) AS r FROM c
WHERE CASE kind WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: NOT regexp_matches(x, '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$'))) = 0 WHEN 'phone' THEN length(nr) BETWEEN 9 AND 15
WHEN 'card' THEN list_sum(list_transform(range(1, length(nr) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(nr)[i] AS INT) WHEN CAST(reverse(nr)[i] AS INT) > 4 THEN 2 * CAST(reverse(nr)[i] AS INT) - 9 ELSE 2 * CAST(reverse(nr)[i] AS INT) END)) % 10 = 0 ELSE true END),
b AS (SELECT k, i, kind, start, stop, kind || ':' || CASE kind WHEN 'email' THEN {low.format('m')} WHEN 'ip' THEN m ELSE nr END AS entity, ({near('l', '2:')})[-{o.NEAR}:] || ({near('r', ':-2')})[:{o.NEAR}] AS near FROM v),
n0 AS (SELECT DISTINCT k, entity, unnest(near) AS term FROM b),
n1 AS (SELECT * FROM n0 UNION SELECT k, entity, left(term, {o.PREFIX}) || '*' FROM n0 WHERE length(term) > {o.PREFIX}),
f AS (SELECT entity, term, count(*) AS f FROM n1 GROUP BY ALL HAVING count(*) >= {o.SUPPORT}),
de AS (SELECT entity, count(DISTINCT k) AS d FROM b GROUP BY entity),
r0 AS (SELECT k, {low.format('t')} AS t FROM d),
r1 AS (SELECT k, t, regexp_extract_all(t, '{runs}') AS ws, regexp_split_to_array(t, '{runs}') AS gs FROM r0),
r2 AS (SELECT k, unnest(ws) AS w, unnest(gs[:len(ws)]) AS g, unnest(range(len(ws))) AS j FROM r1),
r3 AS (SELECT k, w, sum(length(g) + length(w)) OVER (PARTITION BY k ORDER BY j) AS stop FROM r2),
dt AS (SELECT w AS term, count(DISTINCT k) AS n FROM r3 GROUP BY w UNION ALL SELECT left(w, {o.PREFIX}) || '*', count(DISTINCT k) FROM r3 WHERE length(w) > {o.PREFIX} AND {term('w')} GROUP BY 1),
told AS (SELECT DISTINCT term FROM f JOIN de USING (entity) JOIN dt USING (term), (SELECT count(*) AS rows FROM d)
WHERE rows * f::DOUBLE >= {2.0**o.LEAST_BITS} * d * n AND f >= {2.0**-o.RESIDUE!r}::DOUBLE * n AND NOT ends_with(term, '*')),
ts AS (SELECT k, 9 AS i, '{o.TERM}' AS kind, stop - length(w) AS start, stop FROM r3 JOIN told ON w = term),
al AS (SELECT k, i, kind, start, stop FROM b UNION ALL SELECT * FROM ts WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = ts.k AND b.start < ts.stop AND ts.start < b.stop)),
x AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS line FROM al),
g AS (SELECT k, string_agg(line, ',' ORDER BY i, start) AS spans, coalesce(string_agg(line, ',' ORDER BY i, start) FILTER (i < 9), '') AS base, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in [*o.PATTERNS, o.TERM])} FROM x GROUP BY k)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in [*o.PATTERNS, o.TERM])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)"""


def _vector_sql(rounds: int = 2) -> str:
    """Brute force: every part against every entry of its codebook, for vectors of one length that 16 divides."""
    near = """b{i} AS (SELECT vec_id, label, row, part, z.entry, x, list_sum(list_transform(list_zip(x, z.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d
FROM p JOIN c{i} z USING (part) QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY d, z.entry) = 1)"""
    move = """m{i} AS (SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM b{i}) GROUP BY ALL),
n{i} AS (SELECT part, entry, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY pos) AS e FROM m{i} GROUP BY part, entry),
c{j} AS (SELECT c{i}.part, c{i}.entry, coalesce(n{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN n{i} USING (part, entry))"""
    steps = ",\n".join(f"{near.format(i=i)},\n{move.format(i=i, j=i + 1)}" for i in range(rounds))
    return f"""WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS row, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS x
FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT vec_id, label, row, part, x[part * len(x) // 16 + 1:(part + 1) * len(x) // 16] AS x FROM v, range(16) t(part)),
c0 AS (SELECT part, row - 1 AS entry, x AS e FROM p WHERE row <= 64),
{steps},
{near.format(i=rounds)},
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT row, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM b{rounds} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"""


def oracle_sql() -> dict[str, str]:
    norm = f"translate(coalesce(text, ''), '{A_Z}', '{a_z}')"
    return {
        "op2_url_filter": _url_sql(),
        "op3_exact_dedup": f"""WITH t AS (SELECT doc_id, sha256({norm}) AS text_sha256, {norm} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY norm)""",
        "op6_license_scan": op06_license_scan.scan_sql(),
        # Brute force: all pairs of a label, and what is reachable by links.
        "op7_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) x ON x.a = vec_id LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) y ON y.a = vec_id""",
        # Brute force: all pairs of different sets that share a shingle, and what is reachable by links.
        "op8_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({norm}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM w),
k AS (SELECT s, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY s),
u AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM k),
p AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a),
c AS (SELECT doc_id, len(s.s) AS n_shingles, coalesce(least(rep, low), rep, doc_id) AS component_id FROM s LEFT JOIN k ON k.s = s.s LEFT JOIN m ON m.a = rep)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c""",
            "op11_collocations": _phrase_sql(),
        "op12_personal_data": _pii_sql(),
        "op13_vector_compression": _vector_sql(),
    }
