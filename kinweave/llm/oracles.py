"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from kinweave.llm import chat, decontam, hostrep, lemp, mixing, neardup, quality, trie

#: Words of a text, as DuckDB lists.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _op2() -> str:
    bits = " + ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, (_, rule) in enumerate(quality.RULES))
    return rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
    r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY doc_id),
    l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
      FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {quality.POLICIES["base"].mask}) <> 0 AS base_failed,
      (fail_bits & {quality.POLICIES["web"].mask}) = 0 AS kept, fail_bits FROM b"""


def _ablation() -> str:
    mask = quality.POLICIES["web"].mask
    rules = ", ".join(f"('{name}', {1 << i})" for i, (name, _) in enumerate(quality.RULES))
    return f"""
    WITH l AS MATERIALIZED (SELECT fail_bits & {mask} AS bits FROM ({_op2()})), r(rule, bit) AS (VALUES {rules})
    SELECT rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_only_this, count(*) FILTER (bits & ~bit = 0) AS n_kept_without
    FROM l, r GROUP BY rule"""


def _op8() -> str:
    lower, most, suffixes = hostrep.LEAST_STRENGTH, hostrep.MOST_STRENGTH, hostrep.PUBLIC_SUFFIXES
    rules = ", ".join(str(r) for r in hostrep.RULES)

    def strength(level: str) -> str:
        return f"""{level}_g AS (SELECT {level}, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL HAVING sum(n) > 0),
        {level}_s AS (SELECT sum(n) AS t, sum(bad) AS b, sum(n * n) AS n2, count(*) AS k, sum(bad * bad / n) AS sq FROM {level}_g),
        {level}_m AS (SELECT *, b / t AS m, (b / t) * (1 - b / t) AS noise FROM {level}_s),
        {level}_k AS (SELECT coalesce(m, 0.0) AS m, CASE WHEN r > 0 THEN least(greatest(1 / r - 1, {lower}), {most}) ELSE {most} END AS k FROM
          (SELECT m, (sq - b * m - (k - 1) * noise) / nullif(noise * (t - n2 / t - (k - 1)), 0) AS r FROM {level}_m))"""

    return rf"""
    WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
    o AS (SELECT doc_id AS page_id, (coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT AS bad FROM labels WHERE doc_id IS NOT NULL),
    q AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS site FROM p),
    h0 AS (SELECT site AS host, CASE WHEN regexp_matches(site, '^[0-9.]*$') THEN site WHEN array_to_string(string_split(site, '.')[-2:], '.') IN {suffixes} THEN array_to_string(string_split(site, '.')[-2:], '.')
      ELSE string_split(site, '.')[-1] END AS suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM q LEFT JOIN o USING (page_id) WHERE site <> '' GROUP BY site),
    h AS (SELECT *, CASE WHEN length(host) <= length(suffix) + 1 THEN host ELSE string_split(left(host, length(host) - length(suffix) - 1), '.')[-1] || '.' || suffix END AS domain FROM h0),
    {strength("suffix")}, {strength("domain")}, {strength("host")},
    s AS (SELECT suffix, (sum(bad) + (SELECT k * m FROM suffix_k)) / (sum(n) + (SELECT k FROM suffix_k)) AS smean FROM h GROUP BY suffix),
    d AS (SELECT domain, (sum(bad) + (SELECT k FROM domain_k) * any_value(smean)) / (sum(n) + (SELECT k FROM domain_k)) AS dmean FROM h JOIN s USING (suffix) GROUP BY domain),
    e AS (SELECT host, n, bad, n + (SELECT k FROM host_k) AS w, (bad + (SELECT k FROM host_k) * dmean) / (n + (SELECT k FROM host_k)) AS rate FROM h JOIN d USING (domain)),
    l AS (SELECT host AS site, n::BIGINT AS n, bad::BIGINT AS bad, rate, rate - {hostrep.Z} * sqrt(rate * (1 - rate) / (w + 1)) AS low FROM e),
    rules(verdict, h, path) AS (VALUES {rules}),
    f AS (SELECT p.page_id, p.host, p.path, max_by(r.h || r.path, length(r.h || r.path)) AS rule, max_by(r.verdict, length(r.h || r.path)) AS verdict
      FROM p LEFT JOIN rules r ON (p.host = r.h OR suffix(p.host, '.' || r.h)) AND starts_with(p.path, r.path) GROUP BY p.page_id, p.host, p.path)
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN low > (SELECT m FROM suffix_k) THEN 'block' END, 'allow') AS verdict, n, bad, round(rate, 6) AS rate, round(low, 6) AS lower_bound
    FROM f LEFT JOIN l ON l.site = regexp_replace(host, ':[0-9]*$', '')"""


#: Base 32 of a SHA-1 in hexadecimal: five digits are four characters.
BASE32 = """array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(html), 5 * k::INT + 1, 5))::BIGINT) >> s) & 31)::INT + 1, 1)), '')), '')"""

OP9 = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    f AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {BASE32} AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def _op10() -> str:
    escaped = "replace(text, '&', '&amp;')"
    for c in chat.CONTROLS:
        escaped = f"replace({escaped}, '{c}', '{'&lt;' if c[0] == '<' else '&#91;'}{c[1:]}')"
    around = len(chat.OPEN) + 1 + len(chat.CLOSE) + 1
    return f"""
    WITH t AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({around} + length(role) + length({escaped}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""


#: Distinct shingles of a table, for shingle size k; shorter texts have none, or one if whole.
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, short: bool) -> str:
    words = WORDS.replace("coalesce(text, '')", f"coalesce({LOWER}, '')")
    least = "len(w) > 0" if short else "len(w) >= 5"
    return f"""(SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') || CASE WHEN len(w) < 5 THEN ' #' || len(w) ELSE '' END AS g
      FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT {key}, {words} AS w FROM {table}) WHERE {least}))"""


def _op4() -> str:
    return f"""
    WITH b AS {_shingles("benchmark", "item_id", False)}, d AS {_shingles("documents", "doc_id", False)},
    n AS (SELECT item_id, count(*)::BIGINT AS n_item FROM b GROUP BY item_id),
    f AS (SELECT doc_id, item_id, count(*)::BIGINT AS n_found FROM b JOIN d USING (g) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_item, n_found FROM f JOIN n USING (item_id)
    WHERE n_found * {decontam.DENOMINATOR} >= n_item * {decontam.NUMERATOR}"""


def _op6() -> str:
    return f"""
    WITH RECURSIVE s AS MATERIALIZED {_shingles("documents", "doc_id", True)},
    n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE {neardup.DENOMINATOR} * c >= {neardup.NUMERATOR} * (x.n + y.n - c)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(v, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON r.v = e.a WHERE r.m < e.b),
    c AS (SELECT v AS doc_id, min(m) AS m FROM r GROUP BY v)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(coalesce(m, doc_id), doc_id) AS component_id, coalesce(m, doc_id) >= doc_id AS kept
    FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def _op1() -> str:
    """The sweeps are a recursion over the table of cells."""
    m = mixing
    topic = "CASE " + " ".join(f"WHEN contains(coalesce(text, ''), '{sign}') THEN '{name}'" for name, sign in m.TOPICS) + f" ELSE '{m.OTHER}' END"
    goals = ", ".join(f"""
    g_{x} AS MATERIALIZED (SELECT {x}, have, pow(have, {m.TEMPERATURE}) * sum(have) OVER () / sum(pow(have, {m.TEMPERATURE})) OVER () AS g_{x}
      FROM (SELECT {x}, sum(tokens)::DOUBLE AS have FROM c WHERE tokens > 0 GROUP BY {x}))""" for x in m.MARGINS)
    bounds = " UNION ALL ".join(f"SELECT have / g_{x} AS b FROM g_{x} WHERE g_{x} > 0" for x in m.MARGINS)
    keep = "source, lang, topic, tokens, g_source, g_lang, g_topic"
    step = f"""(SELECT {keep}, n + 1 AS n, share * CASE WHEN low THEN {m.LESS} ELSE 1 END AS share, 0.0::DOUBLE AS off,
        CASE WHEN low THEN least(1.0, q) * {m.LESS} ELSE q END AS q FROM (SELECT *, n > 0 AND n % {m.PATIENCE} = 0 AS low FROM r WHERE n < {m.SWEEPS} AND off >= {m.TOLERANCE}))"""
    for x in m.MARGINS:
        step = f"""(SELECT {keep}, n, share, greatest(off, CASE WHEN f > 0 THEN abs(f - 1) ELSE 0 END) AS off, q * f AS q FROM
        (SELECT *, coalesce(g_{x} * share / nullif(sum(tokens * least(1.0, q)) OVER (PARTITION BY {x}), 0), 0) AS f FROM {step}))"""
    return f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, len({WORDS})::BIGINT AS n_tokens FROM documents),
    c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL), {goals},
    s AS MATERIALIZED (SELECT least({m.SHARE}, {m.NEAR} * coalesce(min(b), 1e9)) AS share FROM ({bounds})),
    b AS MATERIALIZED (SELECT {keep}, share FROM c JOIN (SELECT source, g_source FROM g_source) USING (source) JOIN (SELECT lang, g_lang FROM g_lang) USING (lang)
      JOIN (SELECT topic, g_topic FROM g_topic) USING (topic), s WHERE tokens > 0),
    r AS (SELECT {keep}, 0 AS n, share::DOUBLE AS share, 1.0::DOUBLE AS off, share::DOUBLE AS q FROM b
      UNION ALL SELECT {keep}, n, share, max(off) OVER () AS off, q FROM {step}),
    f AS (SELECT source, lang, topic, round(least(1.0, arg_max(q, n)), 6) AS rate FROM r GROUP BY ALL),
    u AS (SELECT *, (('0x' || substr(md5('{m.SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE / {1 << 52}::DOUBLE AS u FROM d)
    SELECT doc_id, source, lang, topic, n_tokens, coalesce(rate, 0.0) AS rate, u < coalesce(rate, 0.0) AS kept FROM u LEFT JOIN f USING (source, lang, topic)"""


def _crc32(digits: str) -> str:
    """The checksum of a text of plain characters, bit by bit."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({digits}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {step}), 4294967295)"


def _op11() -> str:
    return f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT DISTINCT conv_id, {_crc32("conv_id::VARCHAR")} % {trie.HEADS} AS h, conv_id - conv_id % {trie.FAMILY} AS family FROM t),
    u AS (SELECT c.conv_id, 0 AS part, pos, role, text, digest FROM c JOIN t ON t.conv_id = c.family AND pos <= h
      UNION ALL SELECT c.conv_id, 1, pos, role, text, digest FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM u),
    k AS (SELECT conv_id, depth, length(text) AS n_chars, md5(string_agg(md5(role) || digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r),
    p AS MATERIALIZED (SELECT conv_id, depth, n_chars, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM k
      UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM k) FROM c),
    n AS MATERIALIZED (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_chars) AS saved,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY node),
    f AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
    s AS (SELECT p.node, sum(n.saved) AS saved_tokens, count(*) FILTER (f.parent IS NULL) AS n_leaves FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN f ON f.parent = n.node GROUP BY p.node)
    SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM n JOIN s ON s.node = n.node LEFT JOIN f ON f.parent = n.node LEFT JOIN n m ON m.node = n.parent"""


def _op12() -> str:
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % {lemp.NOISE_EVERY} = 0 THEN (label + 1) % {lemp.LABELS} ELSE label END AS label,
      list_transform(embedding, lambda x: floor({lemp.SCALE:.0f} * x::DOUBLE)) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (SELECT a.uid, a.vec_id AS anchor_id, b.vec_id, b.uid AS row, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % {lemp.ANCHOR_EVERY} = 0 AND a.uid <> b.uid),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST, row) <= {lemp.POSITIVES})
    SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.uid = p.uid AND NOT s.same AND {lemp.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {lemp.HIGH} * p.score
    WINDOW w AS (PARTITION BY p.uid, p.row ORDER BY s.score DESC, s.vec_id NULLS LAST, s.row) QUALIFY row_number() OVER w <= {lemp.NEGATIVES}"""


def _margins() -> str:
    each = " UNION ALL ".join(f"SELECT '{x}' AS margin, {x} AS category, tokens, weight FROM w WHERE tokens > 0" for x in mixing.MARGINS)
    return f"""
    WITH w AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens * rate) AS weight FROM ({_op1()}) GROUP BY ALL),
    m AS (SELECT margin, category, sum(tokens) AS have, sum(weight) AS got FROM ({each}) GROUP BY ALL),
    t AS (SELECT margin, category, pow(have, {mixing.TEMPERATURE}) / sum(pow(have, {mixing.TEMPERATURE})) OVER (PARTITION BY margin) AS target, got / nullif(sum(got) OVER (PARTITION BY margin), 0) AS share FROM m)
    SELECT margin, category, round(target, 6) AS target, round(share, 6) AS share, coalesce(abs(share - target) <= {5 * mixing.TOLERANCE} * target, false) AS met,
      (SELECT round(sum(weight) / sum(tokens), 6) FROM w) AS attained FROM t"""


ORACLES = {
    "op1_source_mixing": _op1(),
    "op2_quality_rules": _op2(),
    "op4_decontamination": _op4(),
    "op6_near_duplicates": _op6(),
    "op8_url_filter": _op8(),
    "op9_warc": OP9,
    "quality_ablation": _ablation(),
    "mixing_margins": _margins(),
    "op10_chat_format": _op10(),
    "op11_prefix_trie": _op11(),
    "op12_hard_negatives": _op12(),
}
