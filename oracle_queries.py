"""The SQL twin of each query, for DuckDB on the same tables.

The twin of word2vec_fit gives the trained vocabulary. In rouge_l's input the output
is a subsequence of the ground truth, so its twin needs no recursion; rouge_l_turns has one.
"""

from __future__ import annotations

from pairloom.functions import prompts

SEED = 42


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda t: t <> '')"


def _join(a: str) -> str:
    return f"array_to_string({a}, ' ')"


DOCS = f"""
docs AS MATERIALIZED (SELECT doc_id, lang, text, {_words('text')} AS g FROM documents),
pairs AS MATERIALIZED (
  SELECT doc_id AS pair_id, lang, coalesce(lang, '') || ' ' || coalesce(text, '') AS source, coalesce(text, '') AS ground_truth,
         CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '')
              ELSE regexp_replace(coalesce(text, ''), '((?:[^ ]+ ){{3}}[^ ]+) [^ ]+', '\\1', 'g') END AS output,
         doc_id % 11 <> 0 AS valid
  FROM docs),
ep AS MATERIALIZED (SELECT *, {_words('ground_truth')} AS g, {_words('output')} AS o FROM pairs)"""

TURNS = f"""
tp AS MATERIALIZED (
  SELECT a.conv_id * 1000000 + a.turn AS pair_id, a.role, a.text AS ground_truth, b.text AS output,
         {_words('a.text')} AS g, {_words('b.text')} AS o
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

TRIPLES = f"""{DOCS},
triples AS (
  SELECT pair_id, 'mol2cap: ' || source AS source, ground_truth AS chosen, output AS rejected, 'mol2cap' AS task, source AS body FROM pairs
  UNION ALL
  SELECT pair_id, 'cap2mol: ' || ground_truth, source, output, 'cap2mol', ground_truth FROM pairs),
stripped AS (SELECT *, trim(body, ' ' || chr(9) || chr(10) || chr(13)) AS bare FROM triples)"""


def _clip(table: str, orders: int) -> str:
    """Per pair and n: shared count m, totals tg and th."""
    orders_list = ", ".join(f"({n})" for n in range(1, orders + 1))
    grams = " UNION ALL ".join(
        f"SELECT pair_id, {n} AS n, side, {" || ' ' || ".join(f'w{k}' for k in range(n))} AS gram FROM led WHERE w{n - 1} IS NOT NULL"
        for n in range(1, orders + 1))
    leads = ", ".join(f"lead(w, {k}) OVER place AS w{k}" for k in range(orders))
    return f"""
ns(n) AS (VALUES {orders_list}),
flat AS (
  SELECT pair_id, 0 AS side, unnest(g) AS w, generate_subscripts(g, 1) AS i FROM {table}
  UNION ALL
  SELECT pair_id, 1, unnest(o), generate_subscripts(o, 1) FROM {table}),
led AS (SELECT pair_id, side, {leads} FROM flat WINDOW place AS (PARTITION BY pair_id, side ORDER BY i)),
grams AS ({grams}),
sided AS (SELECT pair_id, n, gram, count(*) FILTER (side = 0) AS cg, count(*) FILTER (side = 1) AS co FROM grams GROUP BY ALL),
clipped AS (SELECT pair_id, n, least(cg, co) AS m FROM sided),
shared AS (SELECT pair_id, n, sum(m) AS m FROM clipped GROUP BY ALL),
stats AS (
  SELECT p.*, ns.n, coalesce(s.m, 0) AS m, greatest(0, len(g) - ns.n + 1) AS tg, greatest(0, len(o) - ns.n + 1) AS th
  FROM {table} p CROSS JOIN ns LEFT JOIN shared s ON s.pair_id = p.pair_id AND s.n = ns.n)"""


def _bleu(weight: float, up_to: int, name: str) -> str:
    return f"""round(CASE WHEN min(m) FILTER (n <= {up_to}) = 0 THEN 0.0 ELSE
      min(CASE WHEN hl > rl THEN 1.0 ELSE exp(1 - rl / nullif(hl, 0)) END)
      * exp(sum({weight} * ln(CASE WHEN m = 0 THEN 1 ELSE m END / d)) FILTER (n <= {up_to})) END, 6) AS {name}"""


def _bleu_rows(group: str = "") -> str:
    by = f"{group}, " if group else ""
    return f"""per_n AS (
  SELECT {by}n, sum(m)::DOUBLE AS m, sum(greatest(th, 1))::DOUBLE AS d, sum(len(g))::DOUBLE AS rl, sum(len(o))::DOUBLE AS hl, count(*) AS n_pairs
  FROM stats GROUP BY ALL)"""


def _f(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END"


ROUGE = f"""
rouge AS (
  SELECT pair_id, n, coalesce(m / nullif(th, 0), 0.0) AS p, coalesce(m / nullif(tg, 0), 0.0) AS r FROM stats WHERE n <= 2),
rouge_f AS (SELECT pair_id, n, p, r, {_f('p', 'r')} AS f FROM rouge)"""


def _meteor(table: str) -> str:
    return f"""
mh AS (SELECT pair_id, w, i, row_number() OVER (PARTITION BY pair_id, w ORDER BY i DESC) AS k FROM (
  SELECT pair_id, unnest(o) AS w, generate_subscripts(o, 1) AS i FROM {table})),
mr AS (SELECT pair_id, w, j, row_number() OVER (PARTITION BY pair_id, w ORDER BY j DESC) AS k FROM (
  SELECT pair_id, unnest(g) AS w, generate_subscripts(g, 1) AS j FROM {table})),
mm AS (SELECT pair_id, i, j FROM mh JOIN mr USING (pair_id, w, k)),
mc AS (SELECT pair_id, i, j, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM mm WINDOW w AS (PARTITION BY pair_id ORDER BY i)),
ms AS (SELECT pair_id, count(*)::DOUBLE AS m, sum(CASE WHEN i = pi + 1 AND j = pj + 1 THEN 0 ELSE 1 END)::DOUBLE AS chunks FROM mc GROUP BY 1),
meteor AS (
  SELECT p.pair_id, CASE WHEN m IS NULL THEN 0.0 ELSE
    (1 - 0.5 * power(chunks / m, 3)) * ((m / len(o)) * (m / len(g)) / (0.9 * (m / len(o)) + 0.1 * (m / len(g)))) END AS meteor
  FROM {table} p LEFT JOIN ms USING (pair_id))"""


def _lcs(table: str) -> str:
    return f"""
lcs(pair_id, i, line) AS (
  SELECT pair_id, 0, list_transform(range(0, len(o) + 1), lambda x: 0::BIGINT) FROM {table}
  UNION ALL
  SELECT l.pair_id, l.i + 1, list_reduce(range(1, len(t.o) + 1), lambda acc, j: list_append(acc,
      CASE WHEN t.o[j] = t.g[l.i + 1] THEN l.line[j] + 1 ELSE greatest(l.line[j + 1], acc[j]) END), [0::BIGINT])
  FROM lcs l JOIN {table} t USING (pair_id) WHERE l.i < len(t.g)),
rl AS (
  SELECT t.pair_id, coalesce(l.line[-1] / nullif(len(o), 0), 0.0) AS p, coalesce(l.line[-1] / nullif(len(g), 0), 0.0) AS r
  FROM {table} t JOIN lcs l ON l.pair_id = t.pair_id AND l.i = len(t.g)),
rouge_l AS (SELECT pair_id, p, r, {_f('p', 'r')} AS f FROM rl)"""


def _text_scorecard(group: str = "") -> str:
    by, using = (f"{group}, ", f"USING ({group})") if group else ("", "ON true")
    return f"""WITH RECURSIVE {TURNS}, {_clip('tp', 4)}, {_bleu_rows(group)}, {ROUGE}, {_meteor('tp')}, {_lcs('tp')},
bl AS (SELECT {by}any_value(n_pairs) AS n_pairs, {_bleu(0.5, 2, 'bleu2')}, {_bleu(0.25, 4, 'bleu4')} FROM per_n {'GROUP BY ' + group if group else ''}),
rm AS (SELECT {by}round(avg(f) FILTER (n = 1), 6) AS rouge1, round(avg(f) FILTER (n = 2), 6) AS rouge2
       FROM rouge_f JOIN tp USING (pair_id) {'GROUP BY ' + group if group else ''}),
rest AS (SELECT {by}round(avg(rouge_l.f), 6) AS rouge_l, round(avg(meteor), 6) AS meteor
       FROM tp JOIN rouge_l USING (pair_id) JOIN meteor USING (pair_id) {'GROUP BY ' + group if group else ''})
SELECT {by}n_pairs, 'alnum' AS tokenizer, bleu2, bleu4, rouge1, rouge2, rouge_l, meteor FROM bl JOIN rm {using} JOIN rest {using}"""


def _word_scorecard() -> str:
    """BLEU and METEOR on words, ROUGE on its own tokens."""
    worded = TURNS
    for side in ("a.text", "b.text"):
        worded = worded.replace(_words(side), f"regexp_extract_all(lower({side}), '[\\p{{L}}\\p{{N}}]+|[^\\s]')")
    return f"""SELECT w.n_pairs, 'words' AS tokenizer, w.bleu2, w.bleu4, r.rouge1, r.rouge2, r.rouge_l, w.meteor
FROM (WITH {worded}, {_clip('tp', 4)}, {_bleu_rows()}, {_meteor('tp')},
  bl AS (SELECT any_value(n_pairs) AS n_pairs, {_bleu(0.5, 2, 'bleu2')}, {_bleu(0.25, 4, 'bleu4')} FROM per_n)
  SELECT bl.*, (SELECT round(avg(meteor), 6) FROM meteor) AS meteor FROM bl) w, ({_text_scorecard()}) r"""


def _meteor_stems(table: str) -> str:
    """Exact matches from the end, then stem matches from the end among the words left."""
    free = lambda side, place: f"""(
  SELECT pair_id, {place}, left(w, 4) AS s, row_number() OVER (PARTITION BY pair_id, left(w, 4) ORDER BY {place} DESC) AS k
  FROM {side} ANTI JOIN mm USING (pair_id, {place}))"""  # noqa: E731
    exact = _meteor(table).split("mc AS (")[0]
    rest = "mc AS (" + _meteor(table).split("mc AS (")[1].replace("FROM mm WINDOW", "FROM every WINDOW")
    return f"""{exact}
stemmed AS (SELECT pair_id, i, j FROM {free('mh', 'i')} JOIN {free('mr', 'j')} USING (pair_id, s, k)),
every AS (SELECT pair_id, i, j FROM mm UNION ALL SELECT pair_id, i, j FROM stemmed),
{rest}"""


# DuckDB's edit distance counts bytes: each other character of the turns becomes an unused control character, all different.
SINGLE = """
odd AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x00-\\x7f]')) AS c FROM conversations),
free AS (SELECT chr(i::INT) AS f, row_number() OVER (ORDER BY i) AS n FROM range(1, 32) r(i) WHERE i NOT IN (9, 10, 13)),
swap AS (
  SELECT coalesce(string_agg(c, '' ORDER BY n), '') AS c, coalesce(string_agg(f, '' ORDER BY n), '') AS f,
         CASE WHEN count(*) < (SELECT count(*) FROM odd) THEN error('more characters than control characters') END AS fits
  FROM (SELECT c, row_number() OVER (ORDER BY c) AS n FROM odd) JOIN free USING (n))"""


def _distance(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, c, f), translate({b}, c, f))"


def _rendered(template: str, source: str) -> str:
    before, _, after = template.partition("{source}")
    return f"{_lit(before)} || {source} || {_lit(after)}"


def _by_task(templates: dict[str, str], source: str) -> str:
    whens = " ".join(f"WHEN '{t}' THEN {_rendered(x, source)}" for t, x in templates.items())
    return f"CASE task {whens} END"


_PROMPT = _by_task(prompts.PREFERENCE, "bare")
_INSTRUCTION = _by_task(prompts.INSTRUCTIONS, "''").replace(" || '' || ''", "")
_INPUT = _by_task(prompts.INPUTS, "bare")
_OPENING = prompts.PREFERENCE["mol2cap"].split("\n\n### Instruction")[0]
_B, _E = prompts.CHAT_BEGIN, prompts.CHAT_END


def _said(role: str, content: str) -> str:
    return f"{_lit(f'{_B}{role}')} || chr(10) || {content} || {_lit(_E)} || chr(10)"


RAW = f"""{DOCS},
raw AS (
  SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN '[CLS] ' ELSE '' END || '[''' || CASE WHEN pair_id % 5 = 0 THEN 'assistant ' ELSE '' END
    || output || '#' || CASE WHEN pair_id % 4 = 0 THEN '\\n' ELSE '' END || ''']' AS output FROM pairs),
bare AS (SELECT pair_id, regexp_replace(output, '^\\[CLS\\] ', '') AS output FROM raw)"""

_UNWRAPPED = "replace(replace(replace(output, '[''', ''), ''']', ''), '\\n', '')"

PROPS = f"""
items AS (SELECT item_id, {_words('text')} AS t FROM benchmark),
spots AS (
  SELECT item_id, 0 AS two, generate_subscripts(t, 1) AS i, unnest(t) AS leaf FROM items
  UNION ALL SELECT item_id, 1, i, t[i] || ' ' || t[i + 1] FROM (SELECT item_id, t, unnest(range(1, len(t))) AS i FROM items)),
leaves AS MATERIALIZED (
  SELECT item_id, leaf, item_id * 100000 + row_number() OVER (PARTITION BY item_id ORDER BY min(two), min(i)) - 1 AS prop_id FROM spots GROUP BY item_id, leaf),
props AS MATERIALIZED (
  SELECT prop_id, 'cat' || item_id % 3 || CASE WHEN item_id % 4 = 0 THEN '' ELSE '__sub' || item_id % 2 END || '__' || leaf AS path, leaf FROM leaves)"""

def _tokens(c: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+|[^\\s]'), ' ')"


def _held(name: str, text: str) -> str:
    """(pair_id, key, yes): the keys that a text holds."""
    return f"""{name} AS MATERIALIZED (
  SELECT pair_id, key, true AS yes FROM (SELECT pair_id, ' ' || {_tokens(text)} || ' ' AS t FROM pairs), keys WHERE contains(t, ' ' || key || ' '))"""


CONFUSION = f"""{DOCS}, {PROPS},
keyed AS MATERIALIZED (SELECT DISTINCT path, {_tokens("string_split(path, '__')[-1]")} AS key FROM props),
keys AS MATERIALIZED (SELECT DISTINCT key FROM keyed),
{_held('gs', 'ground_truth')}, {_held('os', 'output')},
sided AS (SELECT pair_id, key, coalesce(g.yes, false) AS gt, coalesce(o.yes, false) AS ot FROM gs g FULL JOIN os o USING (pair_id, key)),
seen AS (
  SELECT key, count(*) FILTER (gt AND ot) AS tp, count(*) FILTER (gt AND NOT ot) AS fn, count(*) FILTER (NOT gt AND ot) AS fp FROM sided GROUP BY key),
counts AS (
  SELECT path, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp,
         (SELECT count(*) FROM pairs) - coalesce(tp, 0) - coalesce(fn, 0) - coalesce(fp, 0) AS tn FROM keyed LEFT JOIN seen USING (key)),
"""


def _ratios(table: str, lead: str, digits: bool = True) -> str:
    r = lambda e: f"round({e}, 6)" if digits else e
    return f"""SELECT {lead} {r('(tp + tn) / nullif(tp + tn + fp + fn, 0)')} AS accuracy, {r('tp / nullif(tp + fp, 0)')} AS precision,
  {r('tp / nullif(tp + fn, 0)')} AS recall, {r('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM {table}"""


def _long(table: str, lead: str = "") -> str:
    return "(" + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {lead}{m} AS value FROM {table}" for m in ("accuracy", "precision", "recall", "f1")) + ")"


_MACRO = f"""{CONFUSION}
rated AS ({_ratios('counts', 'path,', False)}),
long AS (SELECT metric, string_split(path, '__') AS path, value FROM {_long('rated', 'path, ')}),
level2 AS (SELECT metric, path[1:2] AS path, coalesce(avg(value), 0.0) AS value FROM long WHERE len(path) = 3 GROUP BY ALL),
level1 AS (SELECT metric, path[1:1] AS path, coalesce(avg(value), 0.0) AS value FROM
  (SELECT * FROM long WHERE len(path) = 2 UNION ALL SELECT * FROM level2) GROUP BY ALL),
level0 AS (SELECT metric, path[1:0] AS path, coalesce(avg(value), 0.0) AS value FROM level1 GROUP BY ALL),
macro AS (SELECT metric, array_to_string(path, '__') AS path, round(value, 6) AS value FROM
  (FROM level2 UNION ALL FROM level1 UNION ALL FROM level0))"""


COMBOS = """combos AS (SELECT a.prop_id AS combo_id, a.path AS p1, b.path AS p2 FROM props a JOIN props b ON b.prop_id = a.prop_id + 1
  WHERE contains(a.leaf, ' ') AND contains(b.leaf, ' '))"""


def _combo_sql(compat: bool) -> str:
    negative = "NOT (g1 AND g2) AND (NOT o1 OR o2)" if compat else "NOT (g1 AND g2) AND NOT (o1 AND o2)"
    return f"""{COMBOS},
ck AS MATERIALIZED (SELECT combo_id, k1.key AS k1, k2.key AS k2 FROM combos JOIN keyed k1 ON k1.path = p1 JOIN keyed k2 ON k2.path = p2),
halves AS (SELECT combo_id, k1 AS key, true AS one FROM ck UNION ALL SELECT combo_id, k2, false FROM ck),
met AS (
  SELECT bool_or(one AND gt) AS g1, bool_or(NOT one AND gt) AS g2, bool_or(one AND ot) AS o1, bool_or(NOT one AND ot) AS o2
  FROM halves JOIN sided USING (key) GROUP BY pair_id, combo_id),
combo AS (SELECT count(*) FILTER (g1 AND g2 AND o1 AND o2) AS tp, count(*) FILTER (g1 AND g2 AND NOT (o1 AND o2)) AS fn,
  count(*) FILTER (NOT (g1 AND g2) AND o1 AND o2) AS fp,
  (SELECT count(*) FROM pairs) * (SELECT count(*) FROM ck) - count(*) FILTER (NOT ({negative})) AS tn FROM met)"""


def _heldout(text: str) -> str:
    return f"""WITH {CONFUSION} {_combo_sql(False)}, {_held('hs', text)},
kept AS (SELECT DISTINCT a.pair_id FROM hs a JOIN ck ON a.key = k1 JOIN hs b ON b.pair_id = a.pair_id AND b.key = k2)
SELECT DISTINCT source, ground_truth, output FROM pairs JOIN kept USING (pair_id)"""


VECS = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
vp AS (SELECT a.vec_id AS pair_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
cent AS (
  SELECT label AS query, list(x ORDER BY d) AS vec FROM (
    SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v) GROUP BY ALL) GROUP BY label),
scored AS (SELECT query, vec_id AS item, list_cosine_similarity(vec, e) AS score, label FROM cent, v),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) - 1 AS rank FROM scored)"""


def _bit_fields(c: str) -> str:
    return f"list_transform({c}, lambda x: x > 0)"


SENTENCES = f"""{DOCS},
tok AS MATERIALIZED (SELECT doc_id AS sent_id, unnest(g) AS word FROM docs),
wc AS MATERIALIZED (SELECT word, count(*) AS n FROM tok GROUP BY word),
wt AS (SELECT word, embedding::DOUBLE[] AS vec FROM wc JOIN embeddings ON vec_id = n % (SELECT count(*) FROM embeddings) WHERE n > 3)"""


def _summed(words: str, unknown: bool = False) -> str:
    vec = "coalesce(vec, (SELECT arg_min(embedding, vec_id)::DOUBLE[] FROM embeddings))" if unknown else "vec"
    return f"""
cnt AS (SELECT sent_id, word, count(*) AS c FROM {words} GROUP BY ALL),
dims AS (SELECT sent_id, c, unnest({vec}) AS x, generate_subscripts({vec}, 1) AS d FROM cnt {'LEFT ' if unknown else ''}JOIN wt USING (word)),
sums AS (SELECT sent_id, sum(c * x) AS total, sum(c * x * d) AS weighted FROM dims GROUP BY sent_id)"""


def _summary(rows: str) -> str:
    return f"""SELECT sent_id, round(coalesce(total, 0.0), 3) AS total, round(coalesce(weighted, 0.0), 3) AS weighted
FROM {rows} LEFT JOIN sums USING (sent_id)"""


def _elements(keys: str) -> str:
    """Every element of the summed vectors, for the sentences in ``keys`` (sent_id)."""
    return f"""
cnt AS (SELECT sent_id, word, count(*) AS c FROM tok GROUP BY ALL),
dims AS (SELECT sent_id, c, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM cnt JOIN wt USING (word)),
els AS (SELECT sent_id, d, CAST(CAST(sum(c * x) AS DECIMAL(18,3)) AS VARCHAR) AS x FROM dims GROUP BY ALL),
vecs AS (SELECT sent_id, string_agg(x, ' ' ORDER BY d) AS vec FROM els GROUP BY sent_id)
SELECT sent_id, coalesce(vec, ABSENT) AS vec FROM {keys} LEFT JOIN vecs USING (sent_id)"""


_GLUED = "list_transform(range(1, len(g)), lambda i: g[i] || '_' || g[i + 1])"
_ALT = ("list_filter(flatten(list_transform(range(1, len(g) + 1), lambda i: "
        "[g[i], CASE WHEN i < len(g) THEN g[i] || '_' || g[i + 1] END])), lambda x: x IS NOT NULL)")
_FRAGMENTS = f"string_split(text, '.')"
_LEN = lambda p, c: f"quantile_cont(len(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+|[^\\s]')), {p})"
DPO = f"""{TRIPLES},
dpo AS (SELECT pair_id, task, {_PROMPT} AS prompt, chosen || '</s>' AS chosen, rejected || '</s>' AS rejected FROM stripped)"""


def _lengths(p: float, table: str) -> str:
    return f"""SELECT CAST(floor({_LEN(p, 'prompt')}) AS BIGINT) AS prompt_length,
  CAST(floor({_LEN(p, 'prompt || chosen')}) AS BIGINT) AS chosen_length,
  CAST(floor({_LEN(p, 'prompt || rejected')}) AS BIGINT) AS rejected_length FROM {table}"""


_SHUFFLE = f"md5(doc_id::VARCHAR || ':{SEED}'), doc_id"
_ONE_LINE = lambda c: f"regexp_replace({c}, '[\\t\\r\\n]', ' ', 'g')"

ORACLES: dict[str, str] = {
    "text_scorecard": _text_scorecard(),
    "text_scorecard_by_role": _text_scorecard("role"),
    "bleu_corpus": f"WITH {DOCS}, {_clip('ep', 4)}, {_bleu_rows()} SELECT any_value(n_pairs) AS n_pairs, {_bleu(0.5, 2, 'bleu2')}, {_bleu(0.25, 4, 'bleu4')} FROM per_n",
    "bleu_by_lang": f"WITH {DOCS}, {_clip('ep', 4)}, {_bleu_rows('lang')} SELECT lang, any_value(n_pairs) AS n_pairs, {_bleu(0.5, 2, 'bleu2')}, {_bleu(0.25, 4, 'bleu4')} FROM per_n GROUP BY lang",
    "text_scorecard_words": _word_scorecard(),
    "rouge_1_2": f"""WITH {DOCS}, {_clip('ep', 2)}, {ROUGE} SELECT count(DISTINCT pair_id) AS n_pairs,
      round(avg(p) FILTER (n = 1), 6) AS rouge1_p, round(avg(r) FILTER (n = 1), 6) AS rouge1_r, round(avg(f) FILTER (n = 1), 6) AS rouge1_f,
      round(avg(p) FILTER (n = 2), 6) AS rouge2_p, round(avg(r) FILTER (n = 2), 6) AS rouge2_r, round(avg(f) FILTER (n = 2), 6) AS rouge2_f FROM rouge_f""",
    "rouge_l": f"""WITH {DOCS}, s AS (SELECT pair_id, (len(o) > 0)::INT::DOUBLE AS p, coalesce(len(o) / nullif(len(g), 0), 0.0) AS r FROM ep)
      SELECT pair_id, round(p, 6) AS rouge_l_p, round(r, 6) AS rouge_l_r, round({_f('p', 'r')}, 6) AS rouge_l_f FROM s""",
    "rouge_l_turns": f"WITH RECURSIVE {TURNS}, {_lcs('tp')} SELECT pair_id, round(p, 6) AS rouge_l_p, round(r, 6) AS rouge_l_r, round(f, 6) AS rouge_l_f FROM rouge_l",
    "meteor_exact": f"WITH {DOCS}, {_meteor('ep')} SELECT pair_id, round(meteor, 6) AS meteor FROM meteor",
    "meteor_stems": f"WITH {TURNS}, {_meteor_stems('tp')} SELECT pair_id, round(meteor, 9) AS meteor FROM meteor",
    "char_bleu": f"""WITH {DOCS}, ch AS MATERIALIZED (SELECT pair_id, string_split(ground_truth, '') AS g, string_split(output, '') AS o FROM pairs),
      {_clip('ch', 4)}, {_bleu_rows()} SELECT any_value(n_pairs) AS n_pairs, {_bleu(0.25, 4, 'char_bleu')} FROM per_n""",
    "exact_match": f"WITH {DOCS} SELECT count(*) AS n_pairs, round(avg((output = ground_truth)::INT), 6) AS exact_match, round(avg((output = ground_truth AND valid)::INT), 6) AS exact_match_valid FROM pairs",
    "mean_levenshtein": f"WITH {TURNS}, {SINGLE} SELECT count(*) AS n_pairs, round(avg({_distance('output', 'ground_truth')}), 6) AS levenshtein FROM tp, swap WHERE fits IS NULL",
    "molecule_scorecard": f"""WITH {TURNS}, {SINGLE}, f AS (SELECT pair_id, role, ground_truth AS gt, output AS ot FROM tp),
      ch AS MATERIALIZED (SELECT pair_id, CASE WHEN gt = '' THEN [] ELSE string_split(gt, '') END AS g, CASE WHEN ot = '' THEN [] ELSE string_split(ot, '') END AS o FROM f),
      {_clip('ch', 4)}, {_bleu_rows()},
      bl AS (SELECT any_value(n_pairs) AS n_pairs, {_bleu(0.25, 4, 'char_bleu')} FROM per_n),
      rest AS (SELECT round(avg((lower(gt) = lower(ot) AND role <> 'system')::INT), 6) AS exact_match, round(avg({_distance('ot', 'gt')}), 6) AS levenshtein,
        round(avg((role <> 'system')::INT), 6) AS validity FROM f, swap WHERE fits IS NULL)
      SELECT n_pairs, char_bleu, exact_match, levenshtein, validity FROM bl, rest""",
    "validity": f"""WITH {DOCS} SELECT count(*) AS n_pairs, count(*) FILTER (NOT valid) AS n_invalid, round(avg((lang <> 'de' AND valid)::INT), 6) AS validity_both,
      round(avg(valid::INT), 6) AS validity_output, round(avg((lang <> 'de' AND valid AND output <> '')::INT), 6) AS validity_kept,
      round(count(DISTINCT output) FILTER (valid) / nullif(count(*) FILTER (valid), 0), 6) AS uniqueness FROM pairs""",
    "uniqueness": f"WITH {DOCS} SELECT lang, round(count(DISTINCT output) FILTER (valid) / nullif(count(*) FILTER (valid), 0), 6) AS uniqueness FROM pairs GROUP BY lang",
    "preference_triples": f"WITH {TRIPLES} SELECT pair_id, source, chosen, rejected FROM triples",
    "union_directions": f"WITH {TRIPLES} SELECT task, count(*) AS n, sum(length(bare))::BIGINT AS source_chars, sum(length(chosen))::BIGINT AS chosen_chars, sum(length(rejected))::BIGINT AS rejected_chars FROM stripped GROUP BY task",
    "marker_rejects": f"WITH {RAW} SELECT pair_id, output FROM raw WHERE NOT contains(output, 'mol2cap:') AND NOT contains(output, 'cap2mol:')",
    "dpo_prompts": f"WITH {DPO} SELECT pair_id, prompt, chosen, rejected FROM dpo",
    "kto_unpivot": f"WITH {TRIPLES} SELECT pair_id, source AS prompt, completion, kind = 'chosen' AS label FROM (UNPIVOT (SELECT pair_id, source, chosen, rejected FROM triples) ON chosen, rejected INTO NAME kind VALUE completion)",
    "kto_chat_texts": f"""WITH {TRIPLES}, r AS (SELECT pair_id, {_PROMPT} AS prompt, chosen, rejected FROM stripped)
      SELECT pair_id, {_said('user', 'prompt')} AS prompt, {_said('assistant', 'completion')} AS completion, kind = 'chosen' AS label
      FROM (UNPIVOT r ON chosen, rejected INTO NAME kind VALUE completion)""",
    "sft_instructions": f"WITH {TRIPLES} SELECT pair_id, {_INSTRUCTION} AS instruction, {_INPUT} AS input, chosen AS output FROM stripped",
    "sft_texts": f"""WITH {TRIPLES} SELECT pair_id, trim({_lit(_OPENING)} || chr(10) || chr(10) || '### Instruction:' || chr(10) || {_INSTRUCTION} || chr(10) || chr(10) || '### Input:' || chr(10)
      || {_INPUT} || chr(10) || chr(10) || '### Response:' || chr(10) || chosen, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM stripped""",
    "reward_pairs": f"WITH {TRIPLES} SELECT pair_id, source || chosen AS chosen, source || rejected AS rejected FROM triples",
    "inference_prompts": f"WITH {DOCS} SELECT pair_id, source, {_rendered(prompts.INFERENCE['mol2cap'], 'source')} AS prompt, ground_truth FROM pairs",
    "scored_batches": f"WITH {DOCS} SELECT pair_id, source, ground_truth, replace({_rendered(prompts.INFERENCE['mol2cap'], 'source')}, 'e', '3') AS output FROM pairs",
    "prefix_prompts": f"WITH {DOCS} SELECT pair_id, ground_truth AS source, {_lit(prompts.TRANSLATE_PREFIX['cap2mol'])} || ground_truth AS prompt, source AS ground_truth FROM pairs",
    "task_union": f"""WITH {DOCS} SELECT pair_id, {_lit(prompts.TASK_INSTRUCTION['mol2cap'])} AS instruction, source AS input, ground_truth AS output FROM pairs
      UNION ALL SELECT pair_id, {_lit(prompts.TASK_INSTRUCTION['cap2mol'])}, ground_truth, source FROM pairs""",
    "task_chats": f"""WITH {DOCS}, u AS (SELECT pair_id, {_lit(prompts.TASK_INSTRUCTION['mol2cap'])} || source AS i, ground_truth AS o FROM pairs
      UNION ALL SELECT pair_id, {_lit(prompts.TASK_INSTRUCTION['cap2mol'])} || ground_truth, source FROM pairs)
      SELECT pair_id, {_said('system', _lit(prompts.SYSTEM_MESSAGE))} || {_said('user', 'i')} || {_lit(_B + 'assistant')} || chr(10) AS prompt, o AS reference FROM u""",
    "chat_messages": f"WITH {TURNS} SELECT pair_id, {_said('user', 'ground_truth')} || {_said('assistant', 'output')} AS chat FROM tp WHERE role = 'user'",
    "length_percentiles": f"WITH {DPO}, l AS ({_lengths(0.95, 'dpo')}) SELECT *, greatest(chosen_length, rejected_length) AS max_length FROM l",
    "longest_lengths": f"WITH {DPO}, l AS ({_lengths(1.0, 'dpo')}) SELECT prompt_length, greatest(chosen_length, rejected_length) AS max_length FROM l",
    "dedupe_first": f"WITH {DOCS} SELECT source AS molecule, arg_min(ground_truth, pair_id) AS caption FROM pairs GROUP BY source",
    "holdout_anti": "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))",
    "seeded_shuffle": f"SELECT doc_id, row_number() OVER (ORDER BY {_SHUFFLE}) AS position FROM documents",
    "seeded_sample": f"SELECT doc_id, lang FROM documents ORDER BY {_SHUFFLE} LIMIT 300",
    "fraction_sample": f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (ORDER BY {_SHUFFLE}) <= round_even(0.1 * count(*) OVER (), 0)",
    "strip_cls": f"WITH {RAW} SELECT pair_id, output FROM bare",
    "clean_outputs_a": f"""WITH {RAW} SELECT pair_id, {_UNWRAPPED} AS output, replace({_UNWRAPPED}, '#', '') AS without_hash,
      replace(output[3:-3], '\\n', chr(10)) AS parsed FROM bare""",
    "clean_outputs_b": f"WITH {RAW} SELECT pair_id, split_part(trim(replace({_UNWRAPPED}, 'assistant', '')), ' ', 1) AS output FROM bare",
    "contained_outputs": f"WITH {DOCS}, t AS (SELECT pair_id, {_tokens('output')} AS o, {_tokens('source')} AS s FROM pairs) SELECT pair_id, o = '' OR contains(' ' || s || ' ', ' ' || o || ' ') AS contained FROM t",
    "special_tokens": f"""WITH {DOCS}, t AS (SELECT pair_id, list_filter(string_split('[CLS] ' || ground_truth || ' [SEP] [PAD]', ' ')[1:512], lambda x: x NOT IN ('[PAD]', '[CLS]', '[SEP]')) AS t FROM pairs)
      SELECT pair_id, array_to_string(t, ' ') AS tokens, len(t)::INT AS n_tokens FROM t""",
    "nested_counts": f"""WITH {CONFUSION.rstrip().rstrip(',')},
      p AS (SELECT string_split(path, '__') AS p, tp FROM counts),
      level2 AS (SELECT p[1] AS g, p[2] AS name, '{{' || string_agg('"' || p[3] || '":' || tp, ',' ORDER BY p[3]) || '}}' AS json FROM p WHERE len(p) = 3 GROUP BY ALL),
      level1 AS (SELECT g, '{{' || string_agg('"' || name || '":' || json, ',' ORDER BY name) || '}}' AS json
        FROM (FROM level2 UNION ALL SELECT p[1], p[2], tp::VARCHAR FROM p WHERE len(p) = 2) GROUP BY g)
      SELECT '{{' || string_agg('"' || g || '":' || json, ',' ORDER BY g) || '}}' AS tree FROM level1""",
    "flatten_tree": f"WITH {PROPS} SELECT prop_id, path, leaf FROM props",
    "property_confusion": f"WITH {CONFUSION.rstrip().rstrip(',')} {_ratios('counts', 'path, tp, fn, fp, tn,')}",
    "property_macro": f"WITH {_MACRO} SELECT metric, path, value FROM macro",
    "combo_metrics": f"WITH {CONFUSION} {_combo_sql(False)} {_ratios('combo', 'tp, fn, fp, tn,')}",
    "combo_metrics_compat": f"WITH {CONFUSION} {_combo_sql(True)} {_ratios('combo', 'tp, fn, fp, tn,')}",
    "heldout_rows": _heldout("ground_truth"),
    "heldout_rows_by_source": _heldout("source"),
    "property_report": f"""WITH {_MACRO}, {_combo_sql(False)}, cr AS ({_ratios('combo', '')})
      SELECT metric, CASE WHEN path = '' THEN 'Overall' ELSE path END AS path, value FROM macro
      UNION ALL SELECT metric, 'Held-Out Combo', value FROM {_long('cr')}""",
    "paired_cosine": f"WITH {VECS} SELECT pair_id, round(list_cosine_similarity(a, b), 6) AS similarity FROM vp",
    "negative_cosine": f"""WITH {VECS} SELECT (SELECT round(avg(list_cosine_similarity(a, b)), 6) FROM vp) AS similarity,
      (SELECT round(avg(list_cosine_similarity(x.a, y.b)), 6) FROM vp x, vp y WHERE x.pair_id <> y.pair_id) AS negative_similarity""",
    "topk_retrieval": f"WITH {VECS} SELECT query, item, round(score, 6) AS score, rank, 'label ' || label AS description FROM placed WHERE rank < 20",
    "rank_all": f"WITH {VECS} SELECT query, item, round(score, 6) AS score, rank FROM placed",
    "rank_asked": f"WITH {VECS} SELECT query, item, round(score, 6) AS score, rank FROM placed WHERE query = label",
    "union_splits": "SELECT vec_id AS id, CASE WHEN label < 8 THEN 'train' WHEN label = 8 THEN 'val' ELSE 'test' END AS split, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS length FROM embeddings",
    "tanimoto_bits": f"""WITH {VECS}, z AS (SELECT pair_id, unnest({_bit_fields('a')}) AS a, unnest({_bit_fields('b')}) AS b FROM vp)
      SELECT pair_id, round(coalesce(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a OR b), 0), 0.0), 6) AS similarity FROM z GROUP BY pair_id""",
    "tanimoto_counts": f"WITH {DOCS}, {_clip('ep', 1)} SELECT pair_id, round(coalesce(m / nullif(tg + th - m, 0), 0.0), 6) AS similarity FROM stats",
    "fingerprint_scorecard": f"""WITH {DOCS}, {_clip('ep', 1)},
      s AS (SELECT *, coalesce(len(list_intersect(g, o)) / nullif(len(list_distinct(list_concat(g, o))), 0), 0.0) AS set_sim, coalesce(m / nullif(tg + th - m, 0), 0.0) AS count_sim FROM stats)
      SELECT round(avg(valid::INT), 6) AS validity, round(avg(CASE WHEN valid THEN set_sim ELSE 0 END), 6) AS set_similarity,
        round(avg(CASE WHEN valid THEN count_sim ELSE 0 END), 6) AS count_similarity,
        round(count(DISTINCT output) FILTER (valid) / nullif(count(*) FILTER (valid), 0), 6) AS uniqueness FROM s""",
    "vector_blend": f"""WITH {VECS}, z AS (SELECT pair_id, list_transform(range(1, len(a) + 1), lambda i: 0.25 * a[i] + 0.75 * b[i]) AS x FROM vp)
      SELECT pair_id AS key, round(list_sum(x), 6) AS total, round(sqrt(list_sum(list_transform(x, lambda e: e * e))), 6) AS length FROM z""",
    "vector_lookup": f"""WITH {DOCS}, k AS (SELECT label AS key, arg_max(embedding, vec_id)::DOUBLE[] AS vec FROM embeddings GROUP BY label)
      SELECT pair_id, (len(o) % 12)::INT AS n_words, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS length FROM ep JOIN k ON key = len(o) % 12""",
    "vector_lookup_misses": f"WITH {DOCS} SELECT count(*) AS misses FROM ep WHERE len(o) % 12 NOT IN (SELECT label FROM embeddings)",
    "word2vec_fit": f"WITH {SENTENCES} SELECT word, 16 AS width FROM wc WHERE n >= 3",
    "skipgram_fit": f"WITH {SENTENCES} SELECT word, 16 AS width FROM wc WHERE n >= 3",
    "neighbour_counts": f"""WITH {SENTENCES}, vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM wc WHERE n > 20),
      t AS (SELECT doc_id, unnest(g) AS word, generate_subscripts(g, 1) AS i FROM docs),
      k AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM t JOIN vocab USING (word)),
      one AS (SELECT a.id AS word, b.id AS near FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.p - a.p IN (1, 2))
      SELECT word, near, count(*) AS n FROM (FROM one UNION ALL SELECT near, word FROM one) GROUP BY ALL""",
    "word_counts": f"WITH {SENTENCES} SELECT word, n FROM wc",
    "corpus_file": f"WITH {SENTENCES} SELECT word, n FROM wc",
    "rare_to_unk": f"""WITH {SENTENCES}, r AS (SELECT d.doc_id, d.i, CASE WHEN n <= 3 THEN 'UNK' ELSE d.word END AS word
        FROM (SELECT doc_id, unnest(g) AS word, generate_subscripts(g, 1) AS i FROM docs) d JOIN wc USING (word)),
      s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS sentence FROM r GROUP BY doc_id)
      SELECT doc_id AS sent_id, coalesce(sentence, '') AS sentence FROM docs LEFT JOIN s USING (doc_id)""",
    "ngram_sentences": f"""WITH {DOCS}, d AS (SELECT doc_id AS sent_id, g FROM docs WHERE len(g) > 0)
      SELECT sent_id, 'r0' AS kind, {_join('g')} AS sentence FROM d UNION ALL SELECT sent_id, 'r1', {_join(_GLUED)} FROM d
      UNION ALL SELECT sent_id, 'alt', {_join(_ALT)} FROM d""",
    "fragment_filter": f"""SELECT doc_id, array_to_string(list_filter({_FRAGMENTS}, lambda f: len({_words('f').replace('lambda t: t', 'lambda w: w')}) > 3), '.') AS large,
      array_to_string(list_filter({_FRAGMENTS}, lambda f: len({_words('f').replace('lambda t: t', 'lambda w: w')}) <= 3), '.') AS small FROM documents""",
    "sentence_vectors": f"WITH {SENTENCES}, {_summed('tok')} {_summary('(SELECT doc_id AS sent_id FROM docs)')}",
    "sentence_vector_elements": f"WITH {SENTENCES}, {_elements('(SELECT doc_id AS sent_id FROM docs)')}".replace("ABSENT", "''"),
    "sentence_vectors_unknown": f"WITH {SENTENCES}, {_summed('tok', True)} {_summary('(SELECT doc_id AS sent_id FROM docs)')}",
    "featurize": f"""WITH {DOCS}, tok AS MATERIALIZED (SELECT doc_id AS sent_id, unnest({_ALT}) AS word FROM docs WHERE len(g) > 0),
      wc AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
      wt AS (SELECT word, embedding::DOUBLE[] AS vec FROM wc JOIN embeddings ON vec_id = n % (SELECT count(*) FROM embeddings) WHERE n > 3),
      {_summed('tok')} {_summary('(SELECT doc_id AS sent_id FROM docs WHERE len(g) > 0)')}""",
    "vocabulary_ids": f"WITH {SENTENCES} SELECT word, row_number() OVER (ORDER BY n DESC, word)::INT AS id FROM wc",
    "pad_truncate_ids": f"""WITH {SENTENCES}, vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM wc WHERE n > 3),
      t AS (SELECT doc_id, unnest(g[1:900]) AS word, generate_subscripts(g[1:900], 1) AS i FROM docs),
      c AS (SELECT doc_id, list(coalesce(id, 0) ORDER BY i) AS ids FROM t LEFT JOIN vocab USING (word) GROUP BY doc_id)
      SELECT docs.doc_id AS sent_id, array_to_string(list_resize(coalesce(ids, []), 900, 0), ' ') AS input_ids, least(len(g), 900)::INT AS n_attended FROM docs LEFT JOIN c USING (doc_id)""",
    "reward_token_ids": f"""WITH {SENTENCES}, vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM wc WHERE n > 3),
      r AS (SELECT pair_id, side, {_words("'cap2mol: ' || ground_truth || CASE side WHEN 'chosen' THEN source ELSE output END")}[1:900] AS w
        FROM pairs, (VALUES ('chosen'), ('rejected')) s(side)),
      t AS (SELECT pair_id, side, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM r),
      c AS (SELECT pair_id, side, list(coalesce(id, 0) ORDER BY i) AS ids FROM t LEFT JOIN vocab USING (word) GROUP BY ALL),
      f AS (SELECT pair_id, side, array_to_string(list_resize(ids, 900, 0), ' ') AS ids,
        array_to_string(list_resize(list_transform(ids, lambda x: 1), 900, 0), ' ') AS mask FROM c)
      SELECT pair_id, any_value(ids) FILTER (side = 'chosen') AS input_ids_chosen, any_value(mask) FILTER (side = 'chosen') AS attention_mask_chosen,
        any_value(ids) FILTER (side = 'rejected') AS input_ids_rejected, any_value(mask) FILTER (side = 'rejected') AS attention_mask_rejected
      FROM f GROUP BY pair_id""",
    "prediction_file": f"WITH {DOCS} SELECT {_ONE_LINE('source')} AS source, {_ONE_LINE('ground_truth')} AS ground_truth, {_ONE_LINE('output')} AS output FROM pairs",
    "triple_file": f"WITH {TRIPLES} SELECT source, chosen, rejected FROM triples",
    "record_file": f"WITH {DOCS} SELECT pair_id, ground_truth FROM pairs",
    "id_file": f"WITH {DOCS} SELECT pair_id, {_ONE_LINE('output')} AS output FROM pairs",
    "wide_vector_file": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS length FROM embeddings",
    "feature_file": f"""WITH {DOCS}, tok AS MATERIALIZED (SELECT doc_id AS sent_id, unnest({_ALT}) AS word FROM docs WHERE len(g) > 0),
      wc AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
      wt AS (SELECT word, embedding::DOUBLE[] AS vec FROM wc JOIN embeddings ON vec_id = n % (SELECT count(*) FROM embeddings) WHERE n > 3),
      {_elements('(SELECT doc_id AS sent_id FROM docs WHERE len(g) > 0)')}""".replace("ABSENT", "rtrim(repeat('0.000 ', (SELECT max(len(embedding)) FROM embeddings)))"),
    "public_split": "SELECT conv_id AS chat, turn AS place, text AS content FROM conversations",
    "row_numbers": "SELECT doc_id, sha256(coalesce(text, '')) AS digest, row_number() OVER (ORDER BY doc_id) AS position FROM documents",
    "combo_file": f"WITH {PROPS}, {COMBOS} SELECT p1, p2 FROM combos",
    "report_file": f"WITH {_MACRO} SELECT metric, path, value FROM macro",
}
