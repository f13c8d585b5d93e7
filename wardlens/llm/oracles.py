"""DuckDB statements for the queries of this package that SQL can express.

Without a statement, and tested against brute force in ``tests/llm`` instead: token counts (the
tokenizer is no SQL function), decontamination (SimHash of Spark's hash function), byte strings
(every byte position of every text), pseudonyms (keyed permutations), secret scans (spans of
regular expressions, test battery) and quality rules (iterated robust estimates).
"""

from __future__ import annotations

from wardlens.llm.queries import MIX_SHARE, MIX_WEIGHTS

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _weight(level: str) -> str:
    cases = "".join(f" WHEN '={k}' THEN {float(v)}" for k, v in MIX_WEIGHTS[level].items())
    return f"CASE {level}{cases} ELSE 1.0 END"


def _filled(nodes: str, parent: str, name: str) -> str:
    """Share the parents' budgets among their children (weight w, capacity c)."""
    return f"""
    {name}_a AS (
      SELECT *, c / w AS ratio,
        coalesce(sum(c) OVER (PARTITION BY {parent} ORDER BY c / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
        sum(w) OVER (PARTITION BY {parent} ORDER BY c / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM ({nodes})),
    {name}_b AS (SELECT *, (budget - taken) / rest >= ratio AS is_full FROM {name}_a),
    {name}_c AS (
      SELECT *, budget - coalesce(sum(c) FILTER (WHERE is_full) OVER (PARTITION BY {parent}), 0) AS remaining,
        sum(w) FILTER (WHERE NOT is_full) OVER (PARTITION BY {parent}) AS open_w
      FROM {name}_b),
    {name}_d AS (
      SELECT *, CASE WHEN is_full THEN c ELSE least(CAST(floor(remaining * w / open_w) AS BIGINT), c) END AS q FROM {name}_c),
    {name}_e AS (
      SELECT *, budget - sum(q) OVER (PARTITION BY {parent}) AS lost,
        sum(CASE WHEN NOT is_full AND q < c THEN 1 ELSE 0 END) OVER (PARTITION BY {parent} ORDER BY {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn
      FROM {name}_d),
    {name}_q AS (
      SELECT *, q + CASE WHEN NOT is_full AND q < c AND turn <= lost THEN 1 ELSE 0 END AS quota FROM {name}_e)"""


OP1 = f"""
WITH docs AS (
  SELECT doc_id, len({WORDS.format("coalesce(text, '')")}) AS n_tokens,
    coalesce('=d' || (TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER) % 4), '-') AS domain,
    coalesce('=' || lang, '-') AS lang, coalesce('=' || source, '-') AS source
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 4 AS c FROM docs GROUP BY ALL),
total AS (SELECT least(CAST(floor(sum(tokens) * {MIX_SHARE}) AS BIGINT), sum(c)::BIGINT) AS budget FROM leaves),
{_filled(f"SELECT domain, sum(c)::BIGINT AS c, {_weight('domain')} AS w, any_value(budget) AS budget FROM leaves, total GROUP BY domain", "1", "domain")},
{_filled(f"SELECT l.domain, lang, sum(l.c)::BIGINT AS c, {_weight('lang')} AS w, any_value(quota) AS budget FROM leaves l JOIN domain_q p ON l.domain = p.domain GROUP BY ALL", "domain", "lang")},
{_filled(f"SELECT l.domain, l.lang, source, sum(l.c)::BIGINT AS c, {_weight('source')} AS w, any_value(quota) AS budget FROM leaves l JOIN lang_q p ON l.domain = p.domain AND l.lang = p.lang GROUP BY ALL", "domain, lang", "source")},
plan AS (
  SELECT l.domain, l.lang, l.source, CASE WHEN tokens > 0 THEN CAST(quota AS BIGINT) // tokens ELSE 0 END AS whole, CAST(quota AS BIGINT) AS quota, tokens
  FROM leaves l JOIN source_q s ON l.domain = s.domain AND l.lang = s.lang AND l.source = s.source),
run AS (
  SELECT d.*, whole, quota - whole * tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('0|' || whole || '|' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
  FROM docs d JOIN plan p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source)
SELECT doc_id, CASE WHEN domain <> '-' THEN substr(domain, 2) END AS domain, CASE WHEN lang <> '-' THEN substr(lang, 2) END AS lang,
  CASE WHEN source <> '-' THEN substr(source, 2) END AS source, n_tokens::BIGINT AS n_tokens,
  CAST(whole + CASE WHEN reached <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM run WHERE whole + CASE WHEN reached <= rest THEN 1 ELSE 0 END > 0
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, pos, md5(array_to_string(w[pos : pos + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS nth FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS k FROM r WHERE nth > 1),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS body
  FROM each_word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, hex,
    list_reduce(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789abcdef', hex[i]) - 1), 4)), lambda a, c: a || c) AS bits
  FROM p),
e AS (
  SELECT page_id, payload_bytes, hex, list_reduce(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(bits[k * 5 + j] AS INTEGER) * (1 << (5 - j)))) AS INTEGER), 1)), lambda a, c: a || c) AS payload_digest
  FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""

OP7 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS pos FROM d WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string(w[pos : pos + 4], ' ')) AS h FROM s),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS node, a AS pos FROM both_ways
  UNION
  SELECT node, b FROM reach JOIN both_ways ON reach.pos = both_ways.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node, min(pos) AS low FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


OP11 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.c) = len(v.c))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _tree(name: str, leaves: str) -> str:
    """Nodes of trees of eight-fold runs, and beside each node below a top what stands in its run."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, pos, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8),
{name}_side AS (
  SELECT tree, level, pos,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name} WHERE n > 1)"""


def _walk(name: str, tree: str, start: str) -> str:
    """Folded digest and siblings of each start (id, tree, pos, acc, proof), level by level."""
    return f"""
{name} AS (
  SELECT id, tree, 0 AS level, pos, acc, proof FROM ({start})
  UNION ALL
  SELECT id, w.tree, w.level + 1, w.pos // 8, sha256(before || acc || after), proof || before || after
  FROM {name} w JOIN {tree}_side s ON w.tree = s.tree AND w.level = s.level AND w.pos = s.pos),
{name}_end AS (SELECT id, tree, acc, proof FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)"""


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OTHERS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
# Bits of the decimal id, lowest first in each character, run through the shift register of CRC-32.
_CRC = """xor(list_reduce(
      list_prepend(4294967295, list_transform(range(0, 8 * len(doc_id::VARCHAR)), lambda i: (ascii((doc_id::VARCHAR)[i // 8 + 1]) >> (i % 8)) & 1)),
      lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""

OP12 = f"""
WITH RECURSIVE src AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({_OTHERS} || {_field("text")}) AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256({_OTHERS} || {_field(f"translate(text, {_LETTERS})")}) END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest
  FROM src),
{_tree("lower_tree", "leaves")},
subroots AS (SELECT tree AS lang_tree, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
{_tree("upper_tree", "subroots")},
{_walk("climb", "lower_tree", "SELECT id, tree, pos, coalesce(changed, leaf) AS acc, '' AS proof FROM leaves")},
{_walk("summit", "upper_tree", "SELECT id, s.tree, s.pos, acc, proof FROM climb_end c JOIN subroots s ON c.tree = s.lang_tree")}
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = r.digest AS verified
FROM leaves l JOIN summit_end e USING (id) JOIN subroots s ON s.lang_tree = l.tree, (SELECT digest FROM upper_tree WHERE n = 1) r
"""


def _draw(k: int) -> str:
    return f"('0x' || substr(sha256('1:' || doc_id), {8 * k + 1}, 8))::BIGINT"


OP13 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u,
    {_draw(0)} AS h1, {_draw(1)} AS h2, {_draw(2)} AS h3, {_draw(3)} AS h4
  FROM documents),
c AS (
  SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 :], '') AS suffix FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    """Statement by query name."""
    return {
        "op1_mixing": OP1,
        "op4_phrase_automata": OP4,
        "op5_warc_chunks": OP5,
        "op7_jaccard_orders": OP7,
        "op11_va_search": OP11,
        "op12_merkle_manifest": OP12,
        "op13_fill_middle": OP13,
    }
