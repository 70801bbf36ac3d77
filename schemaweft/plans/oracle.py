"""SQL twins of the registered queries, for DuckDB over the same tables.

They state the semantics directly (full products inside a pair, recursion for the
matching blocks, the full propagation graph), so they also check the Spark plans'
pruning, padding and factoring.
"""

from __future__ import annotations

from schemaweft.catalog import DTYPE_FAMILIES
from schemaweft.functions.names import ABBREVIATIONS
from schemaweft.functions.values import INTERNAL_CODES, JUNK_COLUMNS, JUNK_DTYPES, MIGRATION_BATCHES
from schemaweft.operators.evaluate import DEFAULT_THRESHOLDS
from schemaweft.operators.legacy import JUNK_ORDINAL
from schemaweft.operators.matchers.cupid import OTHER_TYPES, RELATED_TYPES, SAME_TYPE, CupidParameters
from schemaweft.operators.stability import DEFAULT_SEEDS, HIGH_PART, PRIME, SHIFT, STEP
from schemaweft.plans.workload import DTYPE_OF_LANG, WORD_ABBREVIATIONS
from schemaweft.sources.generator import ANCHOR, BASE_SCHEMA, FULL_NAMES, MODULUS, STATUSES, STREETS


def _upper(x: str) -> str:
    """Upper case with the two-letter form of the sharp s."""
    return f"upper(replace({x}, 'ß', 'ss'))"


def _list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _abbreviated(name: str, dictionary: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dictionary.items())
    return _upper(
        f"array_to_string(list_transform(string_split({name}, '_'), lambda t: CASE t {cases} ELSE t END), '_')"
    )


def _no_vowels(name: str) -> str:
    return _upper(f"regexp_replace({name}, '[aeiouAEIOU]', '', 'g')")


_DTYPE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DTYPE_OF_LANG.items()) + " ELSE 'timestamp' END"
_JUNK_ROWS = ", ".join(
    f"({JUNK_ORDINAL + i}, '{n}', '{t}')" for i, (n, t) in enumerate(zip(JUNK_COLUMNS, JUNK_DTYPES))
)

DOCUMENTS = f"""
words AS (
  SELECT coalesce(source, '') AS pair_id, doc_id, lang, source,
         list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS ws
  FROM documents),
named AS (
  SELECT pair_id, doc_id, lang, source,
         coalesce(nullif(concat_ws('_', list_min(ws),
           list_max(list_transform(ws, lambda x: {{'n': length(x), 'w': x}})).w, list_max(ws)), ''), lang || '_text') AS name
  FROM words),
uniq AS (
  SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY pair_id, name ORDER BY doc_id) = 1),
doc AS MATERIALIZED (
  SELECT u.pair_id, u.doc_id AS ordinal, u.name, {_DTYPE} AS dtype,
    CASE WHEN coalesce(l.toxic, 0) = 0 THEN
      CASE WHEN lang = 'de' THEN {_upper("source || '_' || name")}
           WHEN lang = 'fr' THEN {_no_vowels("name")}
           WHEN lang = 'es' THEN {_upper("name")}
           WHEN l.quality = 1 THEN {_abbreviated("name", WORD_ABBREVIATIONS)}
           ELSE name END END AS new_name
  FROM uniq u LEFT JOIN labels l USING (doc_id)),
src AS MATERIALIZED (SELECT pair_id, name AS src, ordinal AS src_ord, dtype FROM doc),
tgt AS MATERIALIZED (
  SELECT pair_id, new_name AS tgt, min(ordinal) AS tgt_ord, arg_min(dtype, ordinal) AS dtype
  FROM doc WHERE new_name IS NOT NULL GROUP BY pair_id, new_name
  UNION ALL
  SELECT p.pair_id, j.n, j.o, j.t FROM (SELECT DISTINCT pair_id FROM doc) p, (VALUES {_JUNK_ROWS}) j(o, n, t)),
truth AS MATERIALIZED (
  SELECT DISTINCT pair_id, name AS src, new_name AS tgt FROM doc WHERE new_name IS NOT NULL)"""

_GRAMS = "list_distinct(list_transform(range(1, greatest(length(lower({0})) - 1, 1)), lambda i: substr(lower({0}), i, 3)))"


def _top(scored: str, k: int = 5, score: str = "score") -> str:
    return f"""
  SELECT pair_id, src, src_ord, tgt, tgt_ord, score,
         CAST(row_number() OVER (PARTITION BY pair_id, src_ord ORDER BY {score} DESC, tgt_ord) AS INTEGER) AS rank
  FROM {scored} QUALIFY rank <= {k}"""


EXACT = """
exact AS MATERIALIZED (
  SELECT s.pair_id, src, src_ord, tgt, tgt_ord, CAST(1.0 AS DOUBLE) AS score, CAST(1 AS INTEGER) AS rank
  FROM src s JOIN tgt t ON s.pair_id = t.pair_id AND s.src = t.tgt)"""

NORMALIZED = """
normalized AS MATERIALIZED (
  SELECT s.pair_id, src, src_ord, tgt, tgt_ord, CAST(1.0 AS DOUBLE) AS score, CAST(1 AS INTEGER) AS rank
  FROM src s JOIN tgt t ON s.pair_id = t.pair_id
   AND replace(lower(src), '_', '') = replace(lower(tgt), '_', '')
  QUALIFY row_number() OVER (PARTITION BY s.pair_id, src_ord ORDER BY tgt_ord) = 1)"""


def _trigram(k: int = 5, name: str = "trigram", src: str = "src", tgt: str = "tgt") -> str:
    return f"""
{name}_s AS MATERIALIZED (SELECT *, {_GRAMS.format("src")} AS g FROM {src}),
{name}_t AS MATERIALIZED (SELECT *, {_GRAMS.format("tgt")} AS h FROM {tgt}),
{name}_p AS (
  SELECT s.pair_id, src, src_ord, tgt, tgt_ord, len(list_intersect(g, h)) AS o, len(g) AS n, len(h) AS m
  FROM {name}_s s JOIN {name}_t t ON s.pair_id = t.pair_id),
{name}_c AS (
  SELECT pair_id, src, src_ord, tgt, tgt_ord,
         CASE WHEN n = 0 OR m = 0 THEN 0.0::DOUBLE ELSE o::DOUBLE / (n + m - o) END AS score FROM {name}_p),
{name} AS MATERIALIZED ({_top(name + "_c", k)})"""


# Targets are taken to be under 200 characters (the longest in the tables has 48): beyond, the
# matcher leaves out popular characters as difflib does, which this does not state.
# A segment is a pair of strings. Its longest common block, earliest in the first and
# then in the second, splits it into a left and a right segment.
SEQUENCE = f"""
low AS MATERIALIZED (SELECT DISTINCT lower(src) AS a0, lower(tgt) AS b0 FROM src JOIN tgt USING (pair_id)),
block AS (
  SELECT a0, b0, a0 AS a, b0 AS b, 0 AS size, 0 AS depth FROM low
  UNION ALL
  SELECT a0, b0, unnest([left(a, i - 1), substr(a, i + n)]) AS a, unnest([left(b, j - 1), substr(b, j + n)]) AS b,
         unnest([n, 0]) AS size, depth + 1
  FROM (
    SELECT *, strpos(b, substr(a, i, n)) AS j FROM (
      SELECT a0, b0, a, b, depth, best.n AS n, -best.i AS i FROM (
        SELECT a0, b0, a, b, depth, list_max(list_transform(range(1, length(a) + 1), lambda p: {{
            'n': len(list_filter(range(1, length(a) - p + 2), lambda l: contains(b, substr(a, p, l)))), 'i': -p}})) AS best
        FROM block WHERE a <> '' AND b <> '') WHERE best.n > 0))),
ratio AS MATERIALIZED (
  SELECT a0, b0, CASE WHEN length(a0) + length(b0) = 0 THEN 1.0::DOUBLE
         ELSE 2.0::DOUBLE * sum(size) / (length(a0) + length(b0)) END AS score
  FROM block GROUP BY a0, b0),
sequence_c AS (
  SELECT s.pair_id, src, src_ord, tgt, tgt_ord, score
  FROM src s JOIN tgt t ON s.pair_id = t.pair_id JOIN ratio ON a0 = lower(src) AND b0 = lower(tgt)),
sequence AS MATERIALIZED ({_top("sequence_c")})"""

_CUPID = CupidParameters()


def _family(dtype: str) -> str:
    cases = " ".join(f"WHEN {dtype} IN ({', '.join(repr(s) for s in spellings)}) THEN '{f}'" for f, spellings in DTYPE_FAMILIES.items())
    return f"CASE {cases} ELSE 'other' END"


def _tokens(name: str) -> str:
    spaced = f"regexp_replace({name}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1_\\2', 'g')"
    spaced = f"regexp_replace({spaced}, '(\\p{{L}})(\\p{{N}})', '\\1_\\2', 'g')"
    spaced = f"regexp_replace({spaced}, '(\\p{{N}})(\\p{{L}})', '\\1_\\2', 'g')"
    return f"list_distinct(list_filter(string_split_regex(lower({spaced}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"


_THESAURUS = ", ".join(f"('{v}', '{k}'), ('{k}', '{v}')" for k, v in WORD_ABBREVIATIONS.items())
_COMPATIBLE = " ".join(
    f"WHEN (sf = '{a}' AND tf = '{b}') OR (sf = '{b}' AND tf = '{a}') THEN {v}" for (a, b), v in RELATED_TYPES.items()
)
_AFFIX = (
    "greatest(len(list_filter(range(1, least(length(t1), length(t2)) + 1), lambda i: left(t1, i) = left(t2, i))), "
    "len(list_filter(range(1, least(length(t1), length(t2)) + 1), lambda i: right(t1, i) = right(t2, i))))"
)


def _wsim(ssim: str) -> str:
    return f"round({_CUPID.w_struct} * {ssim} + (1 - {_CUPID.w_struct}) * lsim, 9)"


CUPID = f"""
sw AS MATERIALIZED (SELECT pair_id, src, src_ord, {_family("dtype")} AS sf, {_tokens("src")} AS st FROM src),
tw AS MATERIALIZED (SELECT pair_id, tgt, tgt_ord, {_family("dtype")} AS tf, {_tokens("tgt")} AS tt FROM tgt),
v1 AS (SELECT DISTINCT unnest(st) AS t1 FROM sw),
v2 AS (SELECT DISTINCT unnest(tt) AS t2 FROM tw),
thesaurus(term, synonym) AS (VALUES {_THESAURUS}),
affix AS (
  SELECT t1, t2, CAST({_AFFIX} AS DOUBLE) / greatest(length(t1), length(t2)) AS sim, {_AFFIX} AS common
  FROM v1 JOIN v2 ON left(t1, {_CUPID.min_affix}) = left(t2, {_CUPID.min_affix})
    OR right(t1, {_CUPID.min_affix}) = right(t2, {_CUPID.min_affix})),
alike AS MATERIALIZED (
  SELECT t1, t2, max(sim) AS sim FROM (
    SELECT t1, t2, 1.0::DOUBLE AS sim FROM v1 JOIN v2 ON t1 = t2
    UNION ALL SELECT t1, t2, 1.0::DOUBLE FROM v1 JOIN thesaurus ON t1 = term JOIN v2 ON t2 = synonym
    UNION ALL SELECT t1, t2, sim FROM affix WHERE common >= {_CUPID.min_affix})
  WHERE sim >= {_CUPID.th_token} GROUP BY t1, t2),
links AS MATERIALIZED (
  SELECT s.pair_id, src_ord, tgt_ord, s.t1, t.t2, sim
  FROM (SELECT pair_id, src_ord, unnest(st) AS t1 FROM sw) s JOIN alike USING (t1)
  JOIN (SELECT pair_id, tgt_ord, unnest(tt) AS t2 FROM tw) t ON t.pair_id = s.pair_id AND t.t2 = alike.t2),
gains AS (
  SELECT pair_id, src_ord, tgt_ord, sum(g) AS gain FROM (
    SELECT pair_id, src_ord, tgt_ord, max(sim) AS g FROM links GROUP BY pair_id, src_ord, tgt_ord, t1
    UNION ALL SELECT pair_id, src_ord, tgt_ord, max(sim) FROM links GROUP BY pair_id, src_ord, tgt_ord, t2)
  GROUP BY ALL),
leaves AS MATERIALIZED (
  SELECT pair_id, src, src_ord, tgt, tgt_ord, gain / (len(st) + len(tt)) AS lsim,
         CASE WHEN sf = tf THEN {SAME_TYPE} {_COMPATIBLE} ELSE {OTHER_TYPES} END AS ssim
  FROM gains JOIN sw USING (pair_id, src_ord) JOIN tw USING (pair_id, tgt_ord)),
strong AS (SELECT * FROM leaves WHERE {_wsim("ssim")} >= {_CUPID.th_accept}),
share AS (
  SELECT pair_id, (count(DISTINCT src_ord) + count(DISTINCT tgt_ord))::DOUBLE / any_value(n) AS s
  FROM strong JOIN (SELECT pair_id, count(*) AS n FROM (SELECT pair_id FROM src UNION ALL SELECT pair_id FROM tgt) GROUP BY 1)
  USING (pair_id) GROUP BY pair_id),
factor AS (
  SELECT pair_id, CASE WHEN coalesce(s, 0) > {_CUPID.th_high} THEN {_CUPID.c_inc}
                       WHEN coalesce(s, 0) < {_CUPID.th_low} THEN {_CUPID.c_dec} ELSE 1.0 END AS f
  FROM (SELECT DISTINCT pair_id FROM src) LEFT JOIN share USING (pair_id)),
cupid_c AS (
  SELECT pair_id, src, src_ord, tgt, tgt_ord, {_wsim("least(1.0, ssim * f)")} AS score
  FROM leaves JOIN factor USING (pair_id)),
cupid AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY pair_id, src_ord ORDER BY score DESC, tgt_ord) AS INTEGER) AS rank
  FROM cupid_c WHERE score >= {_CUPID.th_accept})"""


# The full graph, node by node, by formula c until a pair comes to rest; the similarities of all
# name pairs seed it. Columns: c column pair, m name pair per (i, j); k type pair per family pair; t table.
FLOODING = f"""
sim_s AS MATERIALIZED (SELECT *, {_family("dtype")} AS sf, {_GRAMS.format("src")} AS g FROM src),
sim_t AS MATERIALIZED (SELECT *, {_family("dtype")} AS tf, {_GRAMS.format("tgt")} AS h FROM tgt),
node AS MATERIALIZED (
  SELECT a.pair_id, src, src_ord, sf, tgt, tgt_ord, tf,
         CASE WHEN len(g) = 0 OR len(h) = 0 THEN 0.0::DOUBLE
              ELSE len(list_intersect(g, h))::DOUBLE / (len(g) + len(h) - len(list_intersect(g, h))) END AS s,
         count(*) OVER (PARTITION BY a.pair_id) AS n_all, count(*) OVER (PARTITION BY a.pair_id, sf, tf) AS n_kind
  FROM sim_s a JOIN sim_t b ON a.pair_id = b.pair_id),
flood AS (
  SELECT pair_id, src_ord, tgt_ord, sf, tf, s, n_all, n_kind, 0.0::DOUBLE AS c, s AS m,
         CASE WHEN sf = tf THEN 1.0::DOUBLE ELSE 0.0 END AS k, 0.0::DOUBLE AS t, 0 AS round, 1.0::DOUBLE AS residual
  FROM node
  UNION ALL
  SELECT pair_id, src_ord, tgt_ord, sf, tf, s, n_all, n_kind, nc / top, nm / top, nk / top, nt / top, round + 1,
         sqrt(sum((nc / top - c) ^ 2 + (nm / top - m) ^ 2 + (nk / top - k) ^ 2 / n_kind + (nt / top - t) ^ 2 / n_all)
              OVER (PARTITION BY pair_id))
  FROM (
    SELECT *, max(greatest(nc, nm, nk, nt)) OVER (PARTITION BY pair_id) AS top FROM (
      SELECT *, c + um + t / n_all + uk / n_kind AS nc, um + c AS nm,
             uk + sum(c) OVER (PARTITION BY pair_id, sf, tf) AS nk, t + sum(c) OVER (PARTITION BY pair_id) AS nt
      FROM (SELECT *, m + s AS um, k + CASE WHEN sf = tf THEN 1.0::DOUBLE ELSE 0.0 END AS uk
            FROM flood WHERE round < 1000 AND residual > 1e-6)))),
flooded AS MATERIALIZED (
  SELECT pair_id, src, src_ord, tgt, tgt_ord, tf, node.s AS s, c AS score
  FROM (SELECT pair_id, src_ord, tgt_ord, c FROM flood QUALIFY round = max(round) OVER (PARTITION BY pair_id))
  JOIN node USING (pair_id, src_ord, tgt_ord))"""

_COLUMNS = "pair_id, src, src_ord, tgt, tgt_ord, round(score, 6) AS score, rank"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def _tagged(matchers: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT '{m}' AS matcher, * FROM {m}" for m in matchers)
    labels = ", ".join(f"('{m}')" for m in matchers)
    return f"""
preds AS MATERIALIZED ({union}),
every AS (SELECT matcher, pair_id, src, src_ord FROM src, (VALUES {labels}) v(matcher)),
hit AS (
  SELECT p.*, t.tgt IS NOT NULL AS ok FROM preds p LEFT JOIN truth t
    ON t.pair_id = p.pair_id AND t.src = p.src AND t.tgt = p.tgt),
per_src AS (
  SELECT matcher, pair_id, src, count(*) AS n_cand, max(CASE WHEN rank = 1 THEN score END) AS top_score,
         bool_or(rank = 1 AND ok) AS top_ok, min(CASE WHEN ok THEN rank END) AS rank
  FROM hit GROUP BY matcher, pair_id, src),
outcome AS MATERIALIZED (
  SELECT e.matcher, e.pair_id, e.src, e.src_ord, h.src IS NOT NULL AS known, coalesce(n_cand, 0) AS n_cand,
         top_score, coalesce(top_ok, FALSE) AS top_ok, CASE WHEN h.src IS NOT NULL THEN p.rank END AS rank,
         CASE WHEN h.src IS NULL THEN CASE WHEN n_cand > 0 THEN 'fp' ELSE 'tn' END
              WHEN top_ok THEN 'tp' ELSE 'fn' END AS outcome
  FROM every e LEFT JOIN per_src p ON e.matcher = p.matcher AND e.pair_id = p.pair_id AND e.src = p.src
  LEFT JOIN (SELECT DISTINCT pair_id, src FROM truth) h ON h.pair_id = e.pair_id AND h.src = e.src)"""


M3 = ["exact", "normalized", "trigram"]
EVAL_3 = _with(DOCUMENTS, EXACT, NORMALIZED, _trigram(), _tagged(M3))
EVAL_4 = _with(DOCUMENTS, EXACT, NORMALIZED, _trigram(), SEQUENCE, _tagged([*M3, "sequence"]))

_SUMS = """
  count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp,
  count(*) FILTER (outcome = 'fn') AS fn, count(*) FILTER (outcome = 'tn') AS tn,
  count(*) FILTER (known) AS n_known, coalesce(sum(1.0::DOUBLE / rank), 0) AS rr, count(*) FILTER (rank <= 3) AS at3"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


def _metrics(sums: str, keys: str, more: str = "") -> str:
    return f"""
, sums AS ({sums}), pr AS (SELECT *, {_div("tp", "tp + fp")} AS p, {_div("tp", "tp + fn")} AS r FROM sums)
SELECT {keys}, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall,
  round({_div("2 * p * r", "p + r")}, 6) AS f1, round({_div("rr", "n_known")}, 6) AS mrr,
  round({_div("at3", "n_known")}, 6) AS recall_at_3{more} FROM pr"""


_DROPPED = "NOT EXISTS (SELECT 1 FROM truth t WHERE t.pair_id = p.pair_id AND t.src = p.src)"
_JUNK = "NOT EXISTS (SELECT 1 FROM truth t WHERE t.pair_id = p.pair_id AND t.tgt = p.tgt)"


def _draw(column: int, size: int) -> str:
    start = f"(k % {MODULUS - 1}) * 1103515245 + {12345 * (column + 1)}"
    return f"((({start}) % {MODULUS}) >> 8) % {size}"


BASE = f"""
base AS MATERIALIZED (
  SELECT k AS row_key, {_draw(0, 9999)} + 1 AS id, {_list(FULL_NAMES)}[{_draw(1, 8)} + 1] AS name,
    'user' || ({_draw(2, 999)} + 1) || '@example.com' AS email,
    ({_draw(3, 9900)} + 100) || ' ' || {_list(STREETS)}[{_draw(4, 6)} + 1] AS address_line_1,
    CASE WHEN {_draw(5, 10)} < 7 THEN ''
         WHEN {_draw(6, 3)} = 0 THEN 'Apt ' || ({_draw(7, 50)} + 1)
         WHEN {_draw(6, 3)} = 1 THEN 'Suite ' || ({_draw(7, 401)} + 100)
         ELSE 'Unit ' || ({_draw(7, 20)} + 1) END AS address_line_2,
    CAST(TIMESTAMP '{ANCHOR}' - to_days(CAST({_draw(8, 366)} AS INTEGER)) AS DATE) AS created,
    ({_draw(9, 99001)} + 1000) / 100.0::DOUBLE AS amount, {_list(STATUSES)}[{_draw(10, 4)} + 1] AS status
  FROM (SELECT o_orderkey AS k FROM orders))"""


def _ymd(column: str) -> str:
    return f"CAST(strftime({column}, '%Y%m%d') AS INTEGER)"


def _junk(key: str) -> str:
    return (
        f"CAST({key} % 2 AS INTEGER) AS LEGACY_FLAG, {_list(INTERNAL_CODES)}[{key} % 4 + 1] AS INTERNAL_CODE, "
        f"{_list(MIGRATION_BATCHES)}[{key} % 3 + 1] AS MIGRATION_BATCH"
    )


# The standard steps by hand: which final names every base column ends in.
STANDARD_TRUTH = [
    ("id", "CUST_D"),
    ("name", "CUST_NM1"),
    ("name", "CUST_NM2"),
    ("email", "CUST_ML"),
    ("address_line_1", "CUST_STRS"),
    ("address_line_2", "CUST_STRS"),
    ("created_at", "CUST_CRTD_T"),
    ("amount", "CUST_MNT"),
]
STANDARD_TARGETS = list(dict.fromkeys(t for _, t in STANDARD_TRUTH)) + list(JUNK_COLUMNS)
# One split step doubles the ordinals: the column of base position i is at 2 * i.
STANDARD_ORDINALS = list(zip((2, 4, 5, 6, 8, 12, 14, *(JUNK_ORDINAL + i for i in range(3))), STANDARD_TARGETS))
_TENANT = f"""
src AS MATERIALIZED (SELECT 'one' AS pair_id, n AS src, o AS src_ord
  FROM (VALUES {", ".join(f"({i + 1}, '{n}')" for i, (n, _) in enumerate(BASE_SCHEMA))}) v(o, n)),
tgt AS MATERIALIZED (SELECT 'one' AS pair_id, n AS tgt, o AS tgt_ord
  FROM (VALUES {", ".join(f"({o}, '{n}')" for o, n in STANDARD_ORDINALS)}) v(o, n)),
truth AS MATERIALIZED (SELECT 'one' AS pair_id, s AS src, t AS tgt
  FROM (VALUES {", ".join(f"('{s}', '{t}')" for s, t in STANDARD_TRUTH)}) v(s, t))"""

_SEEDS = ", ".join(f"({s})" for s in DEFAULT_SEEDS)
_PERMUTED = f"""(((tgt_ord % {PRIME}) * ((seed::BIGINT * {STEP} + {SHIFT}) % {PRIME}) + (seed::BIGINT * {SHIFT} + {STEP}) % {PRIME}) % {PRIME}) * {HIGH_PART}
      + tgt_ord // {PRIME}"""
SHUFFLED = f"""
seeds(seed) AS (VALUES {_SEEDS}),
src4 AS (SELECT pair_id || '#' || seed AS pair_id, src, src_ord FROM src, seeds),
tgt4 AS (
  SELECT pair_id || '#' || seed AS pair_id, tgt,
    {_PERMUTED} AS tgt_ord
  FROM tgt, seeds)"""


def _names(expression: str) -> str:
    return f"{_with(DOCUMENTS)} SELECT pair_id, ordinal, name AS src, {expression} AS tgt FROM doc"


_BLANK = r"regexp_replace(name, '^\s+|\s+$', '', 'g')"

# The six matchers over pairs that were read from files: dates are text there, and there is no thesaurus.
FILES = DOCUMENTS.replace("ELSE 'timestamp' END", "ELSE 'string' END")
PLAIN_CUPID = CUPID.replace(f"(VALUES {_THESAURUS})", "(VALUES ('', ''))")
M6 = {
    "exact": "exact_match",
    "normalized": "normalized_match",
    "trigram": "jaccard_trigram_match",
    "sequence": "levenshtein_ratio_match",
    "cupid": "cupid_match",
    "flooding": "similarity_flooding_match",
}
_ALL_SIX = (
    EXACT, NORMALIZED, _trigram(), SEQUENCE, PLAIN_CUPID, FLOODING,
    f"flooding AS MATERIALIZED ({_top('flooded', 5, 'round(score, 9)')})", _tagged(list(M6)),
)
EVAL_6 = _with(FILES, *_ALL_SIX)
EVAL_6_DOCUMENTS = _with(DOCUMENTS, *_ALL_SIX)

ORACLES: dict[str, str] = {
    "base_table_generate": f"""{_with(BASE)} SELECT row_key, id, name, email, address_line_1, address_line_2,
      CAST(created AS VARCHAR) AS created_at, amount, status FROM base""",
    "catalog_metadata": f"""{_with(DOCUMENTS)}
      SELECT pair_id, n_source_cols, n_target_cols, n_mapped, n_matches
      FROM (SELECT pair_id, count(*) AS n_source_cols FROM src GROUP BY 1)
      JOIN (SELECT pair_id, count(*) AS n_target_cols FROM tgt GROUP BY 1) USING (pair_id)
      JOIN (SELECT pair_id, count(DISTINCT src) AS n_mapped, count(*) AS n_matches FROM truth GROUP BY 1) USING (pair_id)""",
    "benchmark_pair_load": f"""{_with(DOCUMENTS)}
      , cols AS (SELECT pair_id, src AS name, dtype FROM src UNION ALL SELECT pair_id, tgt, dtype FROM tgt)
      SELECT 'documents' AS dataset, 'by_source' AS scenario, pair_id || '_ev' AS pair_id, n_source_cols, n_target_cols,
        n_int, n_float, n_str, n_letters, n_matches
      FROM (SELECT pair_id, count(*) AS n_source_cols FROM src GROUP BY 1)
      JOIN (SELECT pair_id, count(*) AS n_target_cols FROM tgt GROUP BY 1) USING (pair_id)
      JOIN (SELECT pair_id, count(*) FILTER (f = 'integer') AS n_int, count(*) FILTER (f = 'real') AS n_float,
              count(*) FILTER (f NOT IN ('integer', 'real')) AS n_str, CAST(sum(length(name)) AS BIGINT) AS n_letters
            FROM (SELECT *, {_family("dtype")} AS f FROM cols) GROUP BY 1) USING (pair_id)
      JOIN (SELECT pair_id, count(*) AS n_matches FROM truth GROUP BY 1) USING (pair_id)
      WHERE length(pair_id) % 2 = 0""",
    "legacy_abbreviate": _names(_abbreviated("name", WORD_ABBREVIATIONS)),
    "legacy_strip_vowels": _names(_no_vowels("name")),
    "legacy_table_prefix": _names(_upper("pair_id || '_' || name")),
    "legacy_case_flip": _names(_upper("name")),
    "legacy_date_format": f"""
      SELECT tab, day, count(*) AS n FROM (
        SELECT 'lineitem' AS tab, {_ymd("l_shipdate")} AS day FROM lineitem
        UNION ALL SELECT 'orders', {_ymd("o_orderdate")} FROM orders
        UNION ALL SELECT 'events', {_ymd("ts")} FROM events) GROUP BY tab, day""",
    "legacy_split_field": f"""
      SELECT tab, k, string_split_regex({_BLANK}, '\\s+')[1] AS NAME1,
        CASE WHEN len(string_split_regex({_BLANK}, '\\s+')) > 1 THEN string_split_regex({_BLANK}, '\\s+')[-1] ELSE '' END AS NAME2
      FROM (SELECT 'part' AS tab, p_partkey AS k, p_name AS name FROM part
            UNION ALL SELECT 'customer', c_custkey, c_name FROM customer)""",
    "legacy_merge_fields": """
      SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_name ELSE s_name || ', ' || n_name END AS STRAS
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "legacy_unit_change": """
      SELECT 'orders' AS tab, o_orderkey AS k, CAST(0 AS INTEGER) AS line, CAST(trunc(o_totalprice * 100) AS BIGINT) AS amount FROM orders
      UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber, CAST(trunc(l_extendedprice * 100) AS BIGINT) FROM lineitem""",
    "legacy_drop_column": "SELECT o_orderkey, o_totalprice FROM orders",
    "legacy_add_junk": f"SELECT o_orderkey, {_junk('o_orderkey')} FROM orders",
    "legacy_table": f"""{_with(BASE)}
      SELECT id AS CUST_D, split_part(name, ' ', 1) AS CUST_NM1, split_part(name, ' ', 2) AS CUST_NM2, email AS CUST_ML,
        CASE WHEN address_line_2 <> '' THEN address_line_1 || ', ' || address_line_2 ELSE address_line_1 END AS CUST_STRS,
        {_ymd("created")} AS CUST_CRTD_T, CAST(trunc(amount * 100) AS BIGINT) AS CUST_MNT, {_junk("id")} FROM base""",
    "legacy_lineage": f"""
      SELECT c_name AS pair_id, s AS src, t AS tgt FROM customer, (VALUES
        {", ".join(f"('{s}', '{t}')" for s, t in STANDARD_TRUTH)}, {", ".join(f"(NULL, '{j}')" for j in JUNK_COLUMNS)}) v(s, t)""",
    "match_exact": f"{_with(DOCUMENTS, EXACT)} SELECT {_COLUMNS} FROM exact",
    "match_normalized": f"{_with(DOCUMENTS, NORMALIZED)} SELECT {_COLUMNS} FROM normalized",
    "match_trigram_topk": f"{_with(DOCUMENTS, _trigram())} SELECT {_COLUMNS} FROM trigram",
    "match_sequence_ratio": f"{_with(DOCUMENTS, SEQUENCE)} SELECT {_COLUMNS} FROM sequence",
    "match_cupid": f"{_with(DOCUMENTS, CUPID)} SELECT {_COLUMNS} FROM cupid",
    "match_flooding": f"""{_with(DOCUMENTS, FLOODING)}, best AS ({_top("flooded", 5, "round(score, 9)")})
      SELECT {_COLUMNS} FROM best""",
    "match_flooding_shortlist": f"""{_with(DOCUMENTS, FLOODING)}
      SELECT pair_id, src, src_ord, CASE WHEN s > 0 THEN arg_min(tgt, tgt_ord) END AS tgt,
        CASE WHEN s > 0 THEN min(tgt_ord) END AS tgt_ord, tf AS tgt_family, round(s, 6) AS s, round(max(score), 6) AS score,
        count(*) AS n_targets
      FROM flooded GROUP BY pair_id, src, src_ord, tf, s""",
    "eval_outcomes": f"{EVAL_3} SELECT matcher, pair_id, src, outcome, n_cand FROM outcome",
    "eval_ranks": f"{EVAL_3} SELECT matcher, pair_id, src, coalesce(rank, 0) AS rank FROM outcome WHERE known",
    "eval_report": EVAL_4
    + _metrics(
        f"""SELECT matcher, 'all' AS pair_id, {_SUMS} FROM outcome GROUP BY matcher
            UNION ALL SELECT matcher, pair_id, {_SUMS} FROM outcome GROUP BY matcher, pair_id""",
        "matcher, pair_id",
    ),
    "eval_six_matchers": EVAL_6_DOCUMENTS
    + _metrics(f"SELECT matcher, pair_id, {_SUMS} FROM outcome GROUP BY matcher, pair_id", "matcher, pair_id"),
    "eval_fixed_sources": EVAL_3
    + _metrics(f"SELECT matcher, {_SUMS} FROM outcome WHERE src_ord % 2 = 0 GROUP BY matcher", "matcher"),
    "eval_report_files": EVAL_3
    + _metrics(f"SELECT matcher, {_SUMS} FROM outcome GROUP BY matcher", "matcher", ", n_known AS n_ranks"),
    "eval_rank_list": f"""{EVAL_3}
      SELECT matcher, pair_id, src_ord // 1000 AS chunk,
        string_agg(coalesce(CAST(rank AS VARCHAR), 'null'), ',' ORDER BY src_ord) AS ranks
      FROM outcome WHERE known GROUP BY matcher, pair_id, chunk""",
    "eval_coverage_curve": f"""{EVAL_3}
      SELECT matcher, threshold, n_covered, round(n_covered::DOUBLE / n, 6) AS coverage,
        round({_div("n_ok", "n_covered")}, 6) AS precision_at_coverage
      FROM (SELECT matcher, CAST(th AS DOUBLE) AS threshold, count(*) AS n, count(*) FILTER (top_score >= th) AS n_covered,
                   count(*) FILTER (top_score >= th AND top_ok) AS n_ok
            FROM outcome, (VALUES {", ".join(f"({t}::DOUBLE)" for t in DEFAULT_THRESHOLDS)}) v(th) GROUP BY matcher, th)""",
    "audit_dropped_hits": f"{EVAL_3} SELECT matcher, {_COLUMNS} FROM preds p WHERE {_DROPPED}",
    "audit_junk_hits": f"{EVAL_3} SELECT matcher, {_COLUMNS} FROM preds p WHERE {_JUNK}",
    "audit_summary": f"""{EVAL_3}
      SELECT matcher, 'report/matcher=' || matcher AS report, 'audit/matcher=' || matcher AS audit,
        (SELECT count(*) FROM preds p WHERE p.matcher = m.matcher AND {_DROPPED}) AS n_dropped_source_mappings,
        (SELECT count(*) FROM preds p WHERE p.matcher = m.matcher AND {_JUNK}) AS n_junk_target_mappings
      FROM (VALUES {", ".join(f"('{m}')" for m in M3)}) m(matcher)""",
    "audit_files": f"""{EVAL_3}
      , bad AS (
          SELECT p.*, 1 AS dropped, 0 AS junk FROM preds p WHERE {_DROPPED}
          UNION ALL SELECT p.*, 0, 1 FROM preds p WHERE {_JUNK}),
      added AS (
        SELECT matcher, sum(dropped) AS d, sum(junk) AS j, count(*) AS n, count(DISTINCT pair_id) AS pairs, sum(rank) AS ranks,
          sum(src_ord) AS src_ords, sum(tgt_ord) AS tgt_ords, sum(length(src) + length(tgt)) AS chars,
          round(sum(round(score, 6)), 3) AS scores
        FROM bad GROUP BY matcher),
      listed AS (
        SELECT 'dropped' AS kind, src AS name, src_ord AS ordinal FROM src p WHERE {_DROPPED}
        UNION ALL SELECT 'junk', tgt, tgt_ord FROM tgt p WHERE {_JUNK}),
      sums AS (SELECT matcher, {_SUMS} FROM outcome GROUP BY matcher),
      pr AS (SELECT matcher, {_div("tp", "tp + fp")} AS p, {_div("tp", "tp + fn")} AS r FROM sums),
      f AS (SELECT matcher, round({_div("2 * p * r", "p + r")}, 6) AS f1 FROM pr)
      SELECT matcher, f1, coalesce(d, 0) AS n_dropped_source_mappings, coalesce(j, 0) AS n_junk_target_mappings,
        (SELECT count(*) FROM listed WHERE kind = 'dropped') AS n_dropped_source_columns,
        (SELECT count(*) FROM listed WHERE kind = 'junk') AS n_junk_target_columns,
        coalesce(n, 0) AS n_hits, coalesce(pairs, 0) AS n_pairs, coalesce(ranks, 0) AS sum_rank,
        coalesce(src_ords, 0) AS sum_src_ord, coalesce(tgt_ords, 0) AS sum_tgt_ord, coalesce(chars, 0) AS hit_chars,
        coalesce(scores, 0) AS sum_score, (SELECT count(*) FROM listed) AS n_listed,
        (SELECT sum(ordinal) FROM listed) AS sum_ordinal, (SELECT sum(length(name)) FROM listed) AS name_chars
      FROM f LEFT JOIN added USING (matcher)""",
    "audit_tenants": f"""{_with(_TENANT, EXACT, NORMALIZED, _trigram(), SEQUENCE, _tagged([*M3, "sequence"]))}
      , full_names(matcher, full_name) AS (VALUES ('exact', 'exact_match'), ('normalized', 'normalized_match'),
        ('trigram', 'jaccard_trigram_match'), ('sequence', 'levenshtein_ratio_match'))
      SELECT full_name AS matcher, 'report/matcher=' || full_name AS report, 'audit/matcher=' || full_name AS audit,
        (SELECT count(*) FROM preds p WHERE p.matcher = m.matcher AND {_DROPPED}) * (SELECT count(*) FROM customer)
          AS n_dropped_source_mappings,
        (SELECT count(*) FROM preds p WHERE p.matcher = m.matcher AND {_JUNK}) * (SELECT count(*) FROM customer)
          AS n_junk_target_mappings
      FROM full_names m""",
    "audit_checks": f"""{_with(DOCUMENTS)}
      SELECT 'sentinels' AS "check", 'none' AS violation, CAST(0 AS BIGINT) AS n
      UNION ALL SELECT 'sentinels_broken', 'junk target without sentinel', count(DISTINCT pair_id) FROM src
      UNION ALL SELECT 'truth', 'none', 0
      UNION ALL SELECT 'predictions', 'none', 0
      UNION ALL SELECT 'coverage', 'source without target', count(*) FROM src p WHERE {_DROPPED} HAVING count(*) > 0
      UNION ALL SELECT 'coverage', 'target without source', count(*) FROM tgt p WHERE {_JUNK} HAVING count(*) > 0""",
    "audit_flattened": f"{EVAL_3} SELECT matcher, pair_id, src, tgt, rank, round(score, 6) AS score FROM preds",
    "audit_benchmark": f"""{EVAL_6}
      , full_names(matcher, full_name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in M6.items())})
      SELECT full_name AS matcher, 'report/matcher=' || full_name AS report, 'audit/matcher=' || full_name AS audit,
        (SELECT count(*) FROM preds p WHERE p.matcher = m.matcher AND length(pair_id) % 2 = 0 AND {_DROPPED}) AS n_dropped_source_mappings,
        (SELECT count(*) FROM preds p WHERE p.matcher = m.matcher AND length(pair_id) % 2 = 0 AND {_JUNK}) AS n_junk_target_mappings
      FROM full_names m""",
    "audit_candidate_profile": f"{EVAL_3} SELECT matcher, pair_id, src, n_cand AS n_candidates FROM outcome",
    "stability_shuffle_lost": f"""{_with(_TENANT, _trigram(), SHUFFLED, _trigram(1, "moved", "src4", "tgt4"))}
      SELECT CAST(split_part(m.pair_id, '#', 2) AS BIGINT) AS seed, c_name AS pair_id, o.src, o.tgt AS orig_tgt,
        round(o.score, 6) AS orig_score, m.tgt AS shuf_tgt, round(m.score, 6) AS shuf_score
      FROM customer, trigram o JOIN moved m ON m.src = o.src
      WHERE o.rank = 1 AND EXISTS (SELECT 1 FROM truth t WHERE t.src = o.src AND t.tgt = o.tgt)
        AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.src = o.src AND t.tgt = m.tgt)""",
    "stability_shuffle_documents": f"""{_with(DOCUMENTS, SHUFFLED, _trigram(1, "moved", "src4", "tgt4"))}
      SELECT CAST(split_part(m.pair_id, '#', 2) AS BIGINT) AS seed, count(*) AS n_sources,
        count(*) FILTER (EXISTS (SELECT 1 FROM truth t WHERE t.pair_id = split_part(m.pair_id, '#', 1)
          AND t.src = m.src AND t.tgt = m.tgt)) AS n_correct
      FROM moved m GROUP BY seed""",
    "stability_shuffle_flooding": f"""{_with(DOCUMENTS, FLOODING)},
      seeds(seed) AS (VALUES {_SEEDS}),
      first AS (
        SELECT * FROM flooded QUALIFY row_number() OVER (PARTITION BY pair_id, src_ord ORDER BY round(score, 9) DESC, tgt_ord) = 1),
      moved AS (
        SELECT * FROM flooded, seeds
        QUALIFY row_number() OVER (PARTITION BY seed, pair_id, src_ord ORDER BY round(score, 9) DESC, {_PERMUTED}) = 1)
      SELECT seed::BIGINT AS seed, pair_id, src, o.tgt AS orig_tgt, round(o.score, 6) AS orig_score, m.tgt AS shuf_tgt,
        round(m.score, 6) AS shuf_score
      FROM first o JOIN moved m USING (pair_id, src)
      WHERE EXISTS (SELECT 1 FROM truth t WHERE t.pair_id = o.pair_id AND t.src = o.src AND t.tgt = o.tgt)
        AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.pair_id = m.pair_id AND t.src = m.src AND t.tgt = m.tgt)""",
    "triage_six_matchers": f"""{EVAL_6_DOCUMENTS} SELECT matcher, pair_id, src,
      CASE WHEN top_score IS NULL THEN 'no_candidate' WHEN top_score >= 0.5 THEN 'accept' ELSE 'review' END AS decision
      FROM outcome""",
    "stability_ties_margin": f"""{_with(DOCUMENTS, _trigram())}
      SELECT pair_id, src, tgt, rank, count(*) OVER (PARTITION BY pair_id, src_ord, round(score, 12)) AS n_tied,
        round(coalesce(score - lead(score) OVER (PARTITION BY pair_id, src_ord ORDER BY rank), -1.0), 6) AS margin
      FROM trigram""",
    "triage": f"""{EVAL_3} SELECT matcher, pair_id, src,
      CASE WHEN top_score IS NULL THEN 'no_candidate' WHEN top_score >= 0.5 THEN 'accept' ELSE 'review' END AS decision
      FROM outcome""",
}
