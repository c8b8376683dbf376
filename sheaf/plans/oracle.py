"""The queries of ``queries.py`` once more, as DuckDB SQL over the sample tables."""

from __future__ import annotations

from sheaf.functions.cards import NOISE_PATTERNS
from sheaf.functions.stopwords import NUMBER_WORDS, english_stop_words
from sheaf.operators.resume import HEADER_PROMPT, SECTIONS
from sheaf.plans import queries as Q
from sheaf.sources import samples as S


def lit(text: str) -> str:
    """SQL literal; characters outside printable ASCII as chr()."""
    parts, plain = [], ""
    for ch in text:
        if ch == "'":
            plain += "''"
        elif " " <= ch <= "~":
            plain += ch
        else:
            if plain:
                parts.append(f"'{plain}'")
                plain = ""
            parts.append(f"chr({ord(ch)})")
    if plain or not parts:
        parts.append(f"'{plain}'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def words(terms) -> str:
    return "(" + ", ".join(lit(t) for t in sorted(terms)) + ")"


WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The stop words of the queries, worked out by hand: single words, and phrases from the longest to the shortest.
SINGLES = ["erin", "hehely", "ing", "inoran", "that", "the", "thth"]
PHRASES = ["thatin ononst", "orre rewh", "the tion"]
BLOCKED = english_stop_words() | NUMBER_WORDS


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def compact(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def blank(x: str) -> str:
    return rf"({x} IS NULL OR NOT regexp_matches({x}, '[^{WS[1:-1]}]'))"


def digest(x: str) -> str:
    return f"md5(array_to_string({x}, chr(10)))"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def token_list(x: str) -> str:
    return (
        rf"list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), "
        rf"lambda t: regexp_full_match(t, '[a-z]{{3,}}') AND t NOT IN {words(BLOCKED)}), "
        r"lambda t: CASE WHEN t = 'datum' THEN 'data' ELSE t END)"
    )


def gram_list(x: str) -> str:
    """[{term, n, i}] of 1-3 grams by n, then place."""

    def size(n: int) -> str:
        term = " || ' ' || ".join(f"{x}[k + {j}]" for j in range(1, n + 1))
        return f"list_transform(range(greatest(len({x}) - {n - 1}, 0)), lambda k: {{'term': {term}, 'n': {n}, 'i': k}})"

    return "list_concat(list_concat(" + size(1) + ", " + size(2) + "), " + size(3) + ")"


# Prepared documents: tokens without explicit stop words, then without phrases.
_PHRASE = "|".join("  ".join(p.split()) for p in PHRASES)


def prepared(docs: str) -> str:
    """CTEs ``tok(doc_id, toks)`` and ``prep(doc_id, tokens, keywords)`` from ``docs(doc_id, text)``."""
    return f"""
    tok AS (
      SELECT doc_id, toks FROM (SELECT doc_id, {token_list('text')} AS toks FROM {docs} WHERE NOT {blank('text')})
      WHERE len(toks) > 0),
    kept AS (SELECT doc_id, list_filter(toks, lambda t: t NOT IN {words(SINGLES)}) AS keywords FROM tok),
    prep AS (
      SELECT * FROM (
        SELECT doc_id, keywords,
          list_filter(string_split(regexp_replace(' ' || array_to_string(keywords, '  ') || ' ', ' (?:{_PHRASE}) ', '', 'g'), ' '),
                      lambda t: t <> '') AS tokens
        FROM kept)
      WHERE len(tokens) > 0)"""


GRAMS = f"""
    gram AS (SELECT doc_id, unnest({gram_list('tokens')}, recursive := true) FROM prep),
    dt AS (SELECT doc_id, term, n, count(*) AS tf, min(i) AS i FROM gram GROUP BY ALL)"""

# Weights: w per document and term, unit length.
WEIGHTS = """
    ndocs AS (SELECT count(*) AS n FROM prep),
    voc AS (SELECT term, count(*) AS df FROM dt GROUP BY term
            HAVING count(*) <= CAST(0.9 AS DOUBLE) * (SELECT n FROM ndocs)),
    raw AS (SELECT doc_id, term, tf, df, tf * (ln((1.0::DOUBLE + ndocs.n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS r
            FROM dt JOIN voc USING (term), ndocs),
    norm AS (SELECT doc_id, sqrt(sum(r * r)) AS len FROM raw GROUP BY doc_id),
    w AS (SELECT doc_id, term, tf, df, r / len AS w FROM raw JOIN norm USING (doc_id))"""

CORPUS = f"WITH {prepared('documents')}, {GRAMS}, {WEIGHTS}"

# Distinct vectors: the first document of every token list.
LEAVES = """
    leaf AS (SELECT min(doc_id) AS leaf, count(*) AS copies, array_to_string(tokens, ' ') AS k FROM prep GROUP BY k),
    lw AS (SELECT doc_id AS leaf, term, w FROM w WHERE doc_id IN (SELECT leaf FROM leaf))"""


# The merge tree by rounds: every pair of clusters that are each other's nearest is merged, ties go to the smaller id.
MERGES = """    size AS (SELECT leaf, copies AS n FROM leaf),
            start AS (SELECT a.leaf AS a, b.leaf AS b, sum(a.w * b.w) * any_value(x.n) * any_value(y.n) AS dot, any_value(x.n) AS na, any_value(y.n) AS nb
              FROM lw a JOIN lw b ON a.term = b.term AND a.leaf < b.leaf JOIN size x ON x.leaf = a.leaf JOIN size y ON y.leaf = b.leaf GROUP BY a.leaf, b.leaf),
            rounds AS (
              SELECT a, b, dot, na, nb, FALSE AS merged, 0::DOUBLE AS sim FROM start
              UNION ALL (
                WITH pairs AS (SELECT * FROM rounds WHERE NOT merged),
                near AS (SELECT x, max(s) AS s, arg_min(y, (-s, y)) AS y FROM (
                    SELECT a AS x, b AS y, round(dot / (na * nb), 12) AS s FROM pairs UNION ALL SELECT b, a, round(dot / (na * nb), 12) FROM pairs) GROUP BY x),
                met AS (SELECT u.x AS keep, u.y AS gone, u.s FROM near u JOIN near v ON v.x = u.y AND v.y = u.x WHERE u.x < u.y AND u.s > 0),
                grown AS (SELECT m.keep, m.gone, p.na + p.nb AS n FROM met m JOIN pairs p ON p.a = m.keep AND p.b = m.gone),
                moved AS (SELECT coalesce(ga.keep, p.a) AS a, coalesce(gb.keep, p.b) AS b, p.dot, coalesce(ga.n, ka.n, p.na) AS na, coalesce(gb.n, kb.n, p.nb) AS nb
                  FROM pairs p LEFT JOIN grown ga ON ga.gone = p.a LEFT JOIN grown gb ON gb.gone = p.b LEFT JOIN grown ka ON ka.keep = p.a LEFT JOIN grown kb ON kb.keep = p.b)
                SELECT least(a, b), greatest(a, b), sum(dot), any_value(CASE WHEN a < b THEN na ELSE nb END), any_value(CASE WHEN a < b THEN nb ELSE na END), FALSE, 0::DOUBLE
                FROM moved WHERE a <> b AND EXISTS (SELECT 1 FROM met) GROUP BY least(a, b), greatest(a, b)
                UNION ALL SELECT keep, gone, 0::DOUBLE, 0, 0, TRUE, s FROM met)),
            tree AS (SELECT b AS gone, a AS keep, round(1 - sim, 12) AS distance FROM rounds WHERE merged)"""

CLUSTERING = f"{CORPUS.replace('WITH', 'WITH RECURSIVE', 1)}, {LEAVES}, {MERGES}"

# The best scored of up to 30 cuts of the tree; `least` is the minimum size of a cluster.
CHOICE = """
    total AS (SELECT sum(copies) AS docs, least(sum(copies), {minimum}) AS least FROM leaf),
    heights AS (SELECT DISTINCT distance FROM (SELECT distance FROM tree WHERE distance > 0
                UNION ALL SELECT 1.0::DOUBLE WHERE (SELECT count(*) FROM tree) < (SELECT count(*) FROM leaf) - 1)),
    placed AS (SELECT distance, row_number() OVER (ORDER BY distance) - 1 AS p, count(*) OVER () AS n FROM heights),
    cand AS (SELECT p // step AS idx, distance FROM (SELECT *, CASE WHEN n <= 30 THEN 1 ELSE n // 30 END AS step FROM placed) WHERE p % step = 0 AND p // step < 30),
    climb AS (SELECT idx, distance AS t, leaf, leaf AS node FROM leaf, cand
              UNION ALL SELECT idx, t, leaf, keep FROM climb JOIN tree ON gone = node WHERE distance < t),
    lab AS (SELECT idx, leaf, min(node) AS label FROM climb GROUP BY idx, leaf),
    csize AS (SELECT idx, label, sum(copies) AS n FROM lab JOIN leaf USING (leaf) GROUP BY idx, label),
    prof AS (SELECT idx, count(*) AS k, max(n) / docs AS largest, coalesce(sum(n) FILTER (WHERE n < least), 0) / docs AS tiny
             FROM csize, total GROUP BY idx, docs HAVING count(*) BETWEEN 2 AND docs - 1 AND max(n) >= any_value(least)),
    sims AS (SELECT a AS x, b AS y, dot / (na * nb) AS s FROM start UNION ALL SELECT b, a, dot / (na * nb) FROM start
             UNION ALL SELECT DISTINCT leaf, leaf, 1.0::DOUBLE FROM lw),
    prods AS (SELECT l.idx, x AS leaf, l.label, sum(s * f.copies) AS dot FROM sims JOIN leaf f ON f.leaf = y JOIN lab l ON l.leaf = y SEMI JOIN prof ON prof.idx = l.idx GROUP BY l.idx, x, l.label),
    own AS (SELECT l.idx, l.leaf, f.copies, c.n, coalesce(p.dot - 1, 0) AS others,
              coalesce((SELECT max(o.dot / z.n) FROM prods o JOIN csize z ON z.idx = o.idx AND z.label = o.label WHERE o.idx = l.idx AND o.leaf = l.leaf AND o.label <> l.label), 0) AS next
            FROM lab l SEMI JOIN prof USING (idx) JOIN leaf f USING (leaf) JOIN csize c ON c.idx = l.idx AND c.label = l.label
            LEFT JOIN prods p ON p.idx = l.idx AND p.leaf = l.leaf AND p.label = l.label),
    apart AS (SELECT idx, copies, n, (n - 1 - others) / (n - 1) AS a, 1 - next AS b FROM own WHERE n > 1),
    score AS (SELECT idx, any_value(k) AS k, coalesce(sum(CASE WHEN greatest(a, b) > 0 THEN copies * (b - a) / greatest(a, b) ELSE 0 END), 0) / any_value(docs)
                - 0.35::DOUBLE * any_value(largest) - 0.20::DOUBLE * any_value(tiny) AS score
              FROM prof LEFT JOIN apart USING (idx), total GROUP BY idx),
    chosen AS (SELECT idx, k, distance AS threshold FROM score JOIN cand USING (idx) ORDER BY round(score, 12) DESC, idx LIMIT 1)"""


def sentence_ctes(source: str) -> str:
    """CTE ``sent(doc_id, s, sentence)`` from ``source(doc_id, text)``."""
    m = "chr(1)"
    base = rf"regexp_replace(regexp_replace(text, '([.!?]){WS}+', '\1' || {m}, 'g'), '\n+', {m}, 'g')"
    pair = r"""array_to_string(list_transform(ws, lambda v, i:
          CASE WHEN i > 1 AND regexp_matches(ws[i - 1], '[a-z0-9)]$') AND regexp_full_match(v, '[A-Z][A-Za-z]{2,}')
                    AND regexp_matches(coalesce(ws[i + 1], ''), '^[A-Z][A-Za-z]{2,}') THEN chr(1) || v
               WHEN i > 1 THEN ' ' || v ELSE v END), '')"""
    clean = "list_filter(list_transform(string_split({}, chr(1)), lambda p: trim(p)), lambda p: p <> '')"
    return rf"""
    sa AS (
      SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i0 FROM (
        SELECT doc_id, list_filter(list_transform(string_split({base}, {m}), lambda p: {compact('p')}), lambda p: p <> '') AS ps
        FROM {source})),
    sb AS (
      SELECT doc_id, i0, unnest(ps) AS x, generate_subscripts(ps, 1) AS i1 FROM (
        SELECT doc_id, i0, CASE WHEN length(x) > 280 OR len(ws) > 45
          THEN {clean.format("regexp_replace(" + pair + ", '[•●▪◦]+ ?| [-–—] | ?; ', chr(1), 'g')")}
          ELSE [x] END AS ps
        FROM (SELECT doc_id, i0, x, string_split(x, ' ') AS ws FROM sa))),
    sc AS (
      SELECT doc_id, i0, i1, cut, unnest(ps) AS x, generate_subscripts(ps, 1) AS i2 FROM (
        SELECT doc_id, i0, i1, length(x) > 220 OR len(string_split(x, ' ')) > 36 AS cut,
          CASE WHEN length(x) > 220 OR len(string_split(x, ' ')) > 36
            THEN {clean.format("regexp_replace(x, '([,;:]) ', '\\1' || chr(1), 'g')")} ELSE [x] END AS ps
        FROM sb)),
    sd AS (
      SELECT doc_id, i0, i1, i2, unnest(ps) AS sentence, generate_subscripts(ps, 1) AS i3 FROM (
        SELECT doc_id, i0, i1, i2,
          CASE WHEN cut AND len(ws) > 36
            THEN list_transform(range(0, len(ws), 28), lambda k: array_to_string(ws[k + 1:k + 28], ' ')) ELSE [x] END AS ps
        FROM (SELECT *, string_split(x, ' ') AS ws FROM sc))),
    sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i0, i1, i2, i3) - 1 AS s, sentence FROM sd)"""


def cluster_terms(docs: str = "prep", label: str = "lab") -> str:
    """CTE ``kt``: scored keyword terms per cluster from ``docs`` and ``label(doc_id, cluster_id)``."""
    return f"""
    kgram AS (SELECT doc_id, unnest({gram_list('keywords')}, recursive := true) FROM {docs}),
    kd AS (SELECT doc_id, term, n, count(*) AS tf, min(i) AS i FROM kgram GROUP BY ALL),
    kt AS (
      SELECT cluster_id, term, n, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, min(doc_id) AS first_doc,
             arg_min(i, doc_id) AS first_i,
             CAST(sum(tf) AS BIGINT) * (1.0::DOUBLE + (n - 1) * 0.2::DOUBLE) + 0.15::DOUBLE * count(*) AS score
      FROM kd JOIN {label} USING (doc_id) GROUP BY cluster_id, term, n
      HAVING term NOT IN {words(SINGLES + PHRASES)}),
    kr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, tf DESC, df DESC,
                     length(term) DESC, first_doc, n, first_i) AS rank FROM kt)"""


def lemma_list(x: str) -> str:
    """Tokens of a text by the queries' lexicon: endings cut off, then judged as tokens."""
    raw = rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '\p{{N}}+') AND t NOT IN {words(BLOCKED)})"
    cut = "regexp_replace(t, '(ing|es|ed)$', '')"
    named = f"list_transform({raw}, lambda t: {{'w': CASE WHEN {cut} = 'datum' THEN 'data' ELSE {cut} END, 'noun': length(t) % 3 <> 0}})"
    return f"list_transform(list_filter({named}, lambda l: regexp_full_match(l.w, '[a-z][a-z-]{{2,}}')), lambda l: l.w)"


LEMMAS = f"""
    lex AS (SELECT * FROM (SELECT doc_id, {lemma_list('text')} AS tokens, {lemma_list('text').replace("lambda l: regexp_full_match", "lambda l: l.noun AND regexp_full_match")} AS keywords
      FROM documents WHERE NOT {blank('text')}) WHERE len(tokens) > 0)"""

LAB = "lab AS (SELECT doc_id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS cluster_id FROM documents)"

URL = (
    "'https://' || CASE WHEN d.doc_id % 2 = 0 THEN 'www.' ELSE '' END || 'jobs.example.com/view/' || d.doc_id || '/'"
)
OPP = f"""
    opp AS (
      SELECT d.doc_id AS doc_pos, 'op-' || d.doc_id AS id, split_part(d.text, chr(10), 1) AS designation,
        CASE WHEN d.doc_id % 7 <> 0 THEN d.text END AS job_description, d.lang AS location,
        CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE d.source END AS company_name,
        CASE WHEN d.doc_id % 97 <> 0 THEN {URL} END AS source_url,
        l.toxic = 0 AS relevant, make_timestamp((1704067200 + d.doc_id * 60) * 1000000) AS date_posted,
        coalesce(l.quality = 1, false) AS applied,
        CASE WHEN l.quality = 1 THEN make_timestamp((1704067200 + 86400 + d.doc_id * 60) * 1000000) END AS applied_date,
        d.text AS whole, l.doc_id IS NOT NULL AS labelled
      FROM documents d LEFT JOIN labels l USING (doc_id))"""

INCOMING = """
    inc AS (
      SELECT doc_pos, 'in-' || doc_pos AS id, ' ' AS designation, whole AS job_description,
        CASE WHEN c = 1 THEN 'remote' END AS location, company_name || ' new' AS company_name, source_url,
        CASE WHEN c = 0 THEN NOT relevant END AS relevant,
        make_timestamp((1735689600 + doc_pos * 60) * 1000000) AS date_posted, false AS applied,
        NULL::TIMESTAMP AS applied_date, 'v' || c AS resume_version_used, doc_pos * 2 + c AS pos
      FROM opp, (VALUES (0), (1)) v(c) WHERE labelled
      UNION ALL
      SELECT page_id, 'page-' || page_id, regexp_extract(html, '<title>([^<]*)</title>', 1), NULL, NULL, '', url, NULL,
        make_timestamp((1735689600 + page_id * 60) * 1000000), false, NULL, NULL, page_id
      FROM pages)"""


def first_value(name: str) -> str:
    ok = f"NOT {blank(name)}"
    return f"coalesce(arg_min({name}, pos) FILTER (WHERE {ok}), arg_min_null({name}, pos)) AS {name}"


MERGED = f"""
    allrows AS (
      SELECT id, designation, job_description, location, company_name, source_url, relevant, date_posted, applied,
             applied_date, NULL::VARCHAR AS resume_version_used, -1 AS pos FROM opp WHERE source_url IS NOT NULL
      UNION ALL
      SELECT id, designation, job_description, location, company_name, source_url, relevant, date_posted, applied,
             applied_date, resume_version_used, pos FROM inc WHERE source_url <> ''),
    merged AS (
      SELECT sha256(source_url) AS source_hash, {first_value('id')}, {first_value('designation')},
        {first_value('job_description')}, {first_value('location')}, {first_value('company_name')}, source_url,
        arg_max(relevant, pos) FILTER (WHERE relevant IS NOT NULL) AS relevant,
        arg_min(date_posted, pos) AS date_posted, arg_max(applied, pos) AS applied,
        arg_max(applied_date, pos) FILTER (WHERE applied_date IS NOT NULL) AS applied_date,
        arg_max(resume_version_used, pos) FILTER (WHERE resume_version_used IS NOT NULL) AS resume_version_used
      FROM allrows GROUP BY source_url)"""


def domain(x: str) -> str:
    host = rf"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)', 1)"
    return rf"coalesce(regexp_replace(lower({host}), '^www\.', ''), '')"


# The result lists that samples.boards makes of the pages, their cards with all fields, and those that a collector looks at.
BOARDS = rf"""
    li AS (SELECT page_id, d, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS ts FROM (SELECT *, {domain('url')} AS d FROM pages)),
    one AS (SELECT page_id, d, length(d) % 3 = 1 AS wide, i - 1 AS i, trim(replace(replace(t, '&amp;', '&'), '&quot;', '"')) AS t
            FROM (SELECT page_id, d, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM li WHERE length(d) % 3 > 0)),
    field AS (SELECT *, 'k' || (i - CASE WHEN i % 5 = 4 THEN 1 ELSE 0 END) AS key, CASE WHEN i % 4 = 1 THEN 'Privacy Office' ELSE 'Firm ' || i END AS firm,
              'Posted on May ' || (i % 28 + 1) || ', 2026' AS posted, page_id * 100 + i AS job FROM one),
    board AS (SELECT page_id, 'https://www.' || d || '/search/' || (page_id // 16) AS source, page_id % 16 + 1 AS page_num, i AS pos, key, job,
              CASE WHEN wide THEN [t, chr(183), firm, 'Rome'] ELSE [t, firm] END AS texts,
              CASE WHEN wide THEN ['new', posted] ELSE [posted] END AS spans,
              CASE WHEN wide THEN 'https://' || d || '/jobs?currentJobId=' || job ELSE 'https://' || d || '/list/' || page_id || '?currentJobId=' || job || '&x=1' END AS link,
              CASE WHEN wide THEN list_filter([t, chr(183), firm, 'Rome', 'new' || posted || 'topmore'], lambda x: x <> '')
                   ELSE list_filter([t, firm, posted || 'more'], lambda x: x <> '') END AS lines,
              CASE WHEN wide THEN 2 ELSE 1 END AS gap, TIMESTAMP '2026-05-01' + INTERVAL 1 DAY * (i % 28) AS date_posted,
              list_filter(CASE WHEN wide THEN [t, firm, 'Rome'] ELSE [t, firm] END, lambda x: x <> '') AS tt FROM field)"""


ARTICLE = rf"""
    art AS (
      SELECT page_id, url, regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS ad,
             regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages),
    seen AS (
      SELECT page_id, url, list_transform([ad, body], lambda h:
        regexp_replace(regexp_replace(regexp_replace(
          replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            h, '[ \t\r\n]+', ' ', 'g'), '</?p>', chr(2), 'g'), '</?h1>|<br>', chr(3), 'g'), '<[^>]*>', '', 'g'),
            '&amp;', '&'), '&quot;', '"'),
          '[ \x02\x03]*\x02[ \x02\x03]*', chr(10) || chr(10), 'g'), ' *\x03[ \x03]*', chr(10), 'g'),
          '^{WS}+|{WS}+\z', '', 'g')) AS texts FROM art),
    found AS (
      SELECT page_id, url, list_filter(texts, lambda t: length(t) >= 80)[1] AS description FROM seen)"""

_NOISE = " OR ".join(
    f"contains(lower(designation || ' ' || coalesce(company_name, '')), {lit(p)})" for p in NOISE_PATTERNS
)
CARDS = f"""
    cards AS (
      SELECT n_name AS source, 1 + o_orderkey // 1000 AS page_num, o_orderkey AS pos, CAST(o_orderkey // 50 AS VARCHAR) AS key,
        o_orderpriority AS designation,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'Privacy Office' ELSE c_name END AS company_name,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE n_name END AS location,
        o_orderdate + to_minutes(o_orderkey % 1440) AS posted
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    named AS (SELECT *, {_NOISE} AS noise FROM cards)"""
FIRST_CARD = """
    firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY source, page_num, key ORDER BY pos) = 1)"""

UPDATES = """
    upd AS (
      SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_id,
        CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false END AS relevant,
        CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS applied
      FROM events WHERE event_type <> 'signup')"""
STATUS = f"""WITH {UPDATES}
    SELECT user_id, arg_max(relevant, (ts, event_id)) FILTER (WHERE relevant IS NOT NULL) AS relevant,
      arg_max(applied, (ts, event_id)) FILTER (WHERE applied IS NOT NULL) AS applied,
      {stamp("arg_max(ts, (ts, event_id)) FILTER (WHERE applied)")} AS applied_date
    FROM upd GROUP BY user_id"""

GIVEN = f"""{CORPUS},
    fine AS (SELECT doc_id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) * 10
               + CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS label FROM documents),
    labels2 AS (
      SELECT g AS grp, doc_id, CASE WHEN g = 0 THEN label ELSE label // 10 END AS label
      FROM fine JOIN prep USING (doc_id), (VALUES (0::BIGINT), (1)) v(g)),
    size AS (SELECT grp, label, count(*) AS n FROM labels2 GROUP BY ALL),
    csum AS (SELECT grp, label, term, sum(w) AS s FROM labels2 JOIN w USING (doc_id) GROUP BY ALL),
    xs AS (SELECT grp, doc_id, c.label AS other, sum(w * s) AS dot FROM labels2 JOIN w USING (doc_id)
             JOIN csum c USING (grp, term) GROUP BY ALL),
    sil AS (
      SELECT l.grp, l.doc_id, l.label, n.n,
        ((n.n - 1) - (coalesce(own.dot, 0) - CASE WHEN norm.doc_id IS NULL THEN 0 ELSE 1 END)) / (n.n - 1) AS a,
        1 - coalesce(far.best, 0) AS b
      FROM labels2 l JOIN size n USING (grp, label)
        LEFT JOIN norm ON norm.doc_id = l.doc_id
        LEFT JOIN xs own ON own.grp = l.grp AND own.doc_id = l.doc_id AND own.other = l.label
        LEFT JOIN (SELECT x.grp, x.doc_id, max(dot / z.n) AS best FROM xs x JOIN size z ON z.grp = x.grp AND z.label = x.other
                     JOIN labels2 m ON m.grp = x.grp AND m.doc_id = x.doc_id AND m.label <> x.other GROUP BY ALL) far
          ON far.grp = l.grp AND far.doc_id = l.doc_id),
    silh AS (SELECT grp, doc_id, label, CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END AS v FROM sil)"""

SUMMARY_DOCS = f"""{OPP},
    odocs AS (SELECT doc_pos AS doc_id, whole AS text FROM opp WHERE NOT {blank('whole')}),
    lab AS (SELECT doc_id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS cluster_id FROM documents
            WHERE doc_id IN (SELECT doc_id FROM odocs))"""
SENTENCE_RANK = f"""WITH {SUMMARY_DOCS}, {prepared('odocs')}, {cluster_terms()}, {sentence_ctes('odocs')},
    folded AS (
      SELECT cluster_id, sentence, min(doc_id) AS first_doc, arg_min(s, (doc_id, s)) AS first_s
      FROM sent JOIN lab USING (doc_id) GROUP BY ALL),
    stok AS (SELECT cluster_id, sentence, first_doc, first_s, {token_list('sentence')} AS toks FROM folded),
    sgram AS (SELECT DISTINCT cluster_id, sentence, first_doc, first_s, term FROM (
      SELECT cluster_id, sentence, first_doc, first_s, unnest({gram_list('toks')}, recursive := true) FROM stok)),
    hit AS (SELECT cluster_id, sentence, g.first_doc, g.first_s, count(*) AS hits FROM sgram g JOIN kt USING (cluster_id, term)
            GROUP BY ALL),
    srank AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY hits DESC, length(sentence) DESC,
                      first_doc, first_s) AS rank FROM hit)"""
SUMMARY = f"""{SENTENCE_RANK},
    summ AS (
      SELECT c.cluster_id, c.total_opportunities, c.first_doc, coalesce(k.ws, []) AS keywords, coalesce(s.ss, []) AS sentences
      FROM (SELECT cluster_id, count(*) AS total_opportunities, min(doc_id) AS first_doc FROM lab GROUP BY ALL) c
        LEFT JOIN (SELECT cluster_id, list(term ORDER BY rank) AS ws FROM kr WHERE rank <= 24 GROUP BY ALL) k USING (cluster_id)
        LEFT JOIN (SELECT cluster_id, list(sentence ORDER BY rank) AS ss FROM srank WHERE rank <= 20 GROUP BY ALL) s
          USING (cluster_id))"""

RESUME = """
    res AS (
      SELECT a.conv_id || '-' || a.turn AS resume_id, a.conv_id,
        ' conv ' || a.conv_id || chr(10) || chr(10) || '# ' || upper(a.role) || chr(10) || a.text
        || coalesce(chr(10) || chr(10) || '# ' || upper(b.role) || chr(10) || b.text, '') AS body
      FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def section(header: str, until: str) -> str:
    start = f"strpos(body, '# {header}')"
    rest = f"substr(body, {start})"
    end = f"strpos({rest}, '# {until}')"
    return f"CASE WHEN {start} = 0 THEN '' ELSE {strip(f'CASE WHEN {end} > 0 THEN left({rest}, {end} - 1) ELSE {rest} END')} END"


_FIRST = "strpos(body, chr(10) || '# ')"
SECTION_ROWS = f"""
    secs AS (
      SELECT resume_id, unnest([
        {{'ord': 0::BIGINT, 'section': 'header', 'body': {strip(f"CASE WHEN {_FIRST} > 0 THEN left(body, {_FIRST} - 1) ELSE body END")}}},
        {{'ord': 1::BIGINT, 'section': 'user', 'body': {section('USER', 'ASSISTANT')}}},
        {{'ord': 2::BIGINT, 'section': 'assistant', 'body': {section('ASSISTANT', 'USER')}}},
        {{'ord': 3::BIGINT, 'section': 'system', 'body': {section('SYSTEM', 'USER')}}}], recursive := true) FROM res)"""
PROMPTS = f"""WITH {OPP}, {RESUME}, {SECTION_ROWS},
    prm AS (
      SELECT resume_id || '/' || doc_pos || '/user' AS prompt_id, resume_id, doc_pos AS job_id, 'user' AS section, 1::BIGINT AS ord,
        'Tailor the text below.' || chr(10) || chr(10) || 'ORIGINAL TEXT:' || chr(10) || {section('USER', 'ASSISTANT')}
        || chr(10) || chr(10) || 'JOB DESCRIPTION:' || chr(10) || job_description AS prompt
      FROM res JOIN opp ON conv_id = doc_pos WHERE job_description <> '')"""

def _tailored(cv: str, on: str) -> str:
    """The shipped sections: headers, prompts and labels are values shared with the engine, rules are not. ``cv`` makes ``(resume_id, body)``."""
    shipped = list(enumerate(SECTIONS))
    gap, line = "chr(10) || chr(10)", "chr(10)"

    def cut(x) -> str:
        return section(x.header, x.until) if x.until else strip(f"substr(body, strpos(body, {lit('# ' + x.header)}))")

    asked = " UNION ALL ".join(
        f"SELECT resume_id, doc_pos AS job_id, {lit(x.name)} AS section, {i}::BIGINT AS ord, {lit(x.header)} AS header, {lit(x.prompt)} || {gap} || {lit('ORIGINAL ' + x.label + ':')} || {line} || "
        f"{cut(x)} || {gap} || 'JOB DESCRIPTION:' || {line} || whole AS prompt FROM cv JOIN opp ON {on} WHERE whole <> ''"
        for i, x in shipped
        if x.prompt
    )
    fixed = " UNION ALL ".join(f"SELECT resume_id, {i} AS ord, {cut(x) if x.header else strip(f'left(body, {_FIRST} - 1)')} AS part FROM cv" for i, x in shipped if not x.prompt)
    return f"""WITH {OPP}, cv AS ({cv}),
    asked AS ({asked}), fixed AS ({fixed}),
    part AS (
      SELECT resume_id, job_id, ord, '# ' || header || {line} || CASE WHEN length(prompt) % 13 = 0 THEN '' ELSE lower(prompt) END AS part FROM asked
      UNION ALL SELECT resume_id, job_id, fixed.ord, part FROM (SELECT DISTINCT resume_id, job_id FROM asked) JOIN fixed USING (resume_id)),
    done AS (SELECT resume_id, job_id, md5(string_agg(part, {gap} ORDER BY ord)) AS resume_digest FROM part WHERE part <> '' GROUP BY ALL)"""


_HEADED = [x.header for x in SECTIONS if x.header]
_BODY = " || ".join(f"chr(10) || chr(10) || {lit('# ' + h)} || chr(10) || coalesce(max(text) FILTER (WHERE turn = {i}), '')" for i, h in enumerate(_HEADED))
EVERY_JOB = f"""{_tailored(f"SELECT 0 AS resume_id, 'conv 0' || {_BODY} AS body FROM conversations", "true")}
    SELECT job_id, section, ord, md5(prompt) AS digest, resume_digest FROM asked JOIN done USING (resume_id, job_id)"""
RESUME_PAIRS = f"""{_tailored(f"SELECT conv_id AS resume_id, 'conv ' || conv_id || {_BODY} AS body FROM conversations GROUP BY conv_id", "resume_id = doc_pos % (SELECT max(conv_id) + 1 FROM conversations)")}
    SELECT resume_id, job_id, section, ord, md5(prompt) AS digest, resume_digest FROM asked JOIN done USING (resume_id, job_id)"""

_DIRTY = "text"
for _clean, _dirty in S.DIRT.items():
    _DIRTY = f"replace({_DIRTY}, {lit(_clean)}, {lit(_dirty)})"
_DIRTY = f"{lit(chr(0) + ' ' + chr(9))} || {_DIRTY} || {lit(' ' + chr(13) + chr(10) + ' ')}"
_SANE = rf"regexp_replace({_DIRTY}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
_SANE = rf"regexp_replace({_SANE}, '\r\n?', chr(10), 'g')"
_SANE = rf"regexp_replace({_SANE}, '[ \t]+', ' ', 'g')"
_SANE = rf"regexp_replace({_SANE}, '\n{{3,}}', chr(10) || chr(10), 'g')"
_SANE = strip(_SANE)


def any_of(terms) -> str:
    return "(" + " OR ".join(f"contains(lower(text), {lit(t.lower())})" for t in terms) + ")"


def statuses(x: str) -> str:
    return f"['Not Started', 'In Progress', 'Completed', 'Failed'][{x} % 4 + 1]"


def oracle() -> dict[str, str]:
    before, after = HEADER_PROMPT.split("{resume}")
    tagged = (
        "regexp_replace(url, '#.*', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || "
        "CASE WHEN page_id % 3 = 0 THEN 'currentJobId=&currentJobId=%34' || page_id ELSE 'x=1' END"
    )
    return {
        "ranked_keywords_by_source": f"""WITH {prepared('documents')}, {LAB}, {cluster_terms()}
            SELECT cluster_id, rank, term, tf, df, round(score, 6) AS score FROM kr WHERE rank <= 20""",
        "ranked_keywords_whole": f"""WITH {prepared('documents')}, {LAB}, {cluster_terms()}
            SELECT cluster_id, count(*) AS terms, max(rank) AS last_rank,
              CAST(sum((rank % 1009) * (df + length(term))) AS BIGINT) AS checksum FROM kr GROUP BY cluster_id""",
        "tokens": f"WITH {prepared('documents')} SELECT doc_id, len(toks) AS n_tokens, {digest('toks')} AS digest FROM tok",
        "stopword_filter": f"""WITH {prepared('documents')} SELECT doc_id, len(tokens) AS n_tokens, len(keywords) AS n_keywords,
            {digest('tokens')} AS tokens_digest, {digest('keywords')} AS keywords_digest FROM prep""",
        "phrase_filter": f"""WITH RECURSIVE {prepared('documents')},
            terms AS (SELECT DISTINCT p FROM (SELECT unnest([toks[1:2], toks[2:3], toks[2:4], toks[4:7]]) AS p FROM tok) WHERE len(p) > 1),
            win AS (SELECT doc_id, i, n, toks[i + 1:i + n] AS p FROM (SELECT doc_id, toks, n, unnest(range(len(toks) - n + 1)) AS i FROM tok, (VALUES (2), (3), (4)) v(n))),
            hit AS (SELECT doc_id, i, max(n) AS n FROM win SEMI JOIN terms USING (p) GROUP BY ALL),
            follow AS (SELECT a.doc_id, a.i, a.n, b.i AS nxt FROM hit a ASOF LEFT JOIN hit b ON a.doc_id = b.doc_id AND a.i + a.n <= b.i),
            taken AS (
              SELECT * FROM follow QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1
              UNION ALL SELECT f.* FROM taken t JOIN follow f ON f.doc_id = t.doc_id AND f.i = t.nxt),
            place AS (SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) - 1 AS k FROM tok),
            gone AS (SELECT doc_id, unnest(range(i, i + n)) AS k FROM taken),
            stays AS (SELECT doc_id, list(w ORDER BY k) AS ws FROM place ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
            SELECT doc_id, len(ws) AS n_tokens, len(toks) AS n_keywords, {digest('ws')} AS digest FROM stays JOIN tok USING (doc_id)""",
        "dynamic_stopwords": f"""WITH {prepared('documents')}
            SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(keywords)) AS term FROM prep) GROUP BY term
            HAVING count(*) >= greatest(2, ceil((SELECT count(*) FROM prep) * {Q.DYNAMIC_SHARE}::DOUBLE))""",
        "dynamic_filter": f"""WITH {prepared('documents')},
            dyn AS (SELECT term FROM (SELECT unnest(list_distinct(keywords)) AS term FROM prep) GROUP BY term
                    HAVING count(*) >= greatest(2, ceil((SELECT count(*) FROM prep) * {Q.DYNAMIC_SHARE}::DOUBLE))),
            words AS (SELECT coalesce(list(term), []) AS ws FROM dyn),
            f AS (SELECT doc_id, list_filter(tokens, lambda t: NOT list_contains(ws, t)) AS tokens FROM prep, words)
            SELECT doc_id, len(tokens) AS n_tokens, {digest('tokens')} AS digest FROM f WHERE len(tokens) > 0""",
        "ngrams": f"""WITH {prepared('documents')}, {GRAMS}
            SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(sum(tf) AS BIGINT) AS grams, count(*) AS terms, max(tf) AS top_tf,
              CAST(sum(i * length(term)) AS BIGINT) AS checksum FROM dt GROUP BY doc_id, n""",
        "sentences": f"""WITH {sentence_ctes('documents')}
            SELECT doc_id, count(*) AS n_sentences, max(length(sentence)) AS longest,
              md5(string_agg(sentence, chr(10) ORDER BY s)) AS digest FROM sent GROUP BY doc_id""",
        "sanitize_text": f"""SELECT doc_id, length(t) AS n_chars, md5(t) AS digest
            FROM (SELECT doc_id, {_SANE} AS t FROM documents)""",
        "preview": """SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview,
            length(text) > 200 AS shortened FROM documents""",
        "list_normalise": f"""WITH parts AS (
              SELECT conv_id, turn, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
                SELECT conv_id, turn, list_transform(regexp_split_to_array(text, '[.,]'), lambda x: {strip('x')}) AS ps FROM conversations)),
            firsts AS (SELECT conv_id, turn, p, min(i) AS i FROM parts WHERE p <> '' GROUP BY ALL),
            lists AS (SELECT conv_id, turn, list(p ORDER BY i) AS ps FROM firsts GROUP BY ALL)
            SELECT conv_id, turn, coalesce(len(ps), 0) AS entries, {digest('coalesce(ps, [])')} AS digest
            FROM conversations LEFT JOIN lists USING (conv_id, turn)""",
        "domain_key": f"""WITH {OPP}, u AS (SELECT url FROM pages UNION ALL SELECT source_url FROM opp)
            SELECT url, {domain('upper(url)')} AS domain FROM u""",
        "canonical_url": f"""WITH u AS (SELECT page_id, {tagged} AS url FROM pages)
            SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.linkedin.com/jobs/view/4' || page_id || '/' ELSE url END AS canonical,
              'none' AS job_id FROM u""",
        "id_scan": r"""WITH t AS (
              SELECT 'p' || page_id AS key, html || ' ' || (page_id + 10000000) || ' 123456789012 1234567 ' || (page_id + 10000000) AS body FROM pages
              UNION ALL SELECT 'd' || doc_id, text FROM documents),
            hits AS (SELECT key, unnest(h) AS id, generate_subscripts(h, 1) AS i FROM (
              SELECT key, regexp_extract_all(body, '\b(\d{8,12})\b', 1) AS h FROM t)),
            firsts AS (SELECT key, id, min(i) AS i FROM hits GROUP BY ALL),
            lists AS (SELECT key, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM firsts GROUP BY key)
            SELECT key, coalesce(n, 0) AS n_ids, coalesce(ids, '') AS ids FROM t LEFT JOIN lists USING (key)""",
        "search_predicate": f"""SELECT doc_id, {lit(' AND '.join('(' + ' OR '.join(g) + ')' for g in (Q.SCOPE, Q.SKILLS, Q.PLACES)))} AS query
            FROM documents WHERE {any_of(Q.SCOPE)} AND {any_of(Q.SKILLS)} AND {any_of(Q.PLACES)}""",
        "card_clean": f"WITH {CARDS} SELECT pos, designation, company_name, location, noise FROM named",
        "card_dates": f"""WITH {CARDS} SELECT pos,
            CASE WHEN pos % 13 = 0 THEN '' ELSE 'Posted on ' || CASE WHEN pos % 3 = 0 THEN strftime(posted, '%B %-d, %Y, %-I:%M %p') ELSE strftime(posted, '%B %-d, %Y') END END AS date_text,
            {stamp(f"CASE WHEN pos % 13 = 0 THEN TIMESTAMP '{Q.NOW}' WHEN pos % 3 = 0 THEN date_trunc('minute', posted) ELSE date_trunc('day', posted) END")} AS date_posted
            FROM named""",
        "card_dedup": f"WITH {CARDS}, {FIRST_CARD} SELECT source, page_num, pos, key FROM firsts",
        "card_cap": f"""WITH RECURSIVE {CARDS}, {FIRST_CARD},
            near AS (SELECT *, row_number() OVER (PARTITION BY source, page_num ORDER BY pos) AS idx FROM firsts WHERE page_num <= 5),
            looks AS (
              SELECT source, 0 AS page, 0 AS look, 0::BIGINT AS kept FROM (SELECT DISTINCT source FROM near)
              UNION ALL
              SELECT l.source, l.page + 1, CAST(30 - l.kept AS INTEGER),
                l.kept + (SELECT count(*) FROM near n WHERE n.source = l.source AND n.page_num = l.page + 1
                            AND n.idx <= 30 - l.kept AND NOT n.noise)
              FROM looks l WHERE l.page < 5)
            SELECT n.source, page_num, pos, idx, company_name FROM near n JOIN looks l ON l.source = n.source AND l.page = n.page_num
            WHERE idx <= look AND NOT noise""",
        "source_lookup": f"""WITH {OPP},
            conf AS (SELECT DISTINCT d FROM (SELECT {domain('source_url')} AS d FROM opp UNION ALL
                     SELECT {domain('url')} FROM pages WHERE {domain('url')} LIKE '%.example.net') WHERE d <> '')
            SELECT CASE WHEN c.d IS NULL THEN 1 ELSE 0 END::BIGINT AS part, url AS source, {domain('url')} AS domain, 'div.' || c.d AS selector
            FROM pages LEFT JOIN conf c ON c.d = {domain('url')}""",
        "empty_sources": "SELECT CAST(doc_id AS VARCHAR) AS source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "page_cards": r"""WITH nav AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a [^>]*>([^<]*)</a></li>', 1) AS ts FROM pages)
            SELECT page_id, i - 1 AS pos, nullif(replace(replace(trim(t), '&amp;', '&'), '&quot;', '"'), '') AS first_text
            FROM (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM nav)""",
        "layout_cards": f"""WITH {BOARDS}
            SELECT page_id, pos, key, array_to_string(texts, '|') AS texts, array_to_string(spans, '|') AS spans,
              length(array_to_string(lines, '')) + gap * (len(lines) - 1) AS html_length, link FROM board""",
        "collect_pages": f"""WITH RECURSIVE {BOARDS},
            firsts AS (SELECT * FROM board QUALIFY row_number() OVER (PARTITION BY source, page_num, key ORDER BY pos) = 1),
            named AS (SELECT *, tt[1] AS designation, tt[2] AS company_name, tt[3] AS location FROM firsts),
            near AS (SELECT *, ({_NOISE}) AS noise, row_number() OVER (PARTITION BY source, page_num ORDER BY pos) AS idx FROM named),
            looks AS (
              SELECT source, 0 AS page, 0 AS look, 0::BIGINT AS kept FROM (SELECT DISTINCT source FROM near)
              UNION ALL
              SELECT l.source, l.page + 1, CAST(10 - l.kept AS INTEGER),
                l.kept + (SELECT count(*) FROM near n WHERE n.source = l.source AND n.page_num = l.page + 1
                            AND n.idx <= 10 - l.kept AND NOT n.noise)
              FROM looks l WHERE l.page < 16)
            SELECT designation, company_name, location, 'https://www.linkedin.com/jobs/view/' || job || '/' AS source_url,
              {stamp('date_posted')} AS date_posted, false AS applied
            FROM near n JOIN looks l ON l.source = n.source AND l.page = n.page_num WHERE idx <= look AND NOT noise""",
        "page_descriptions": f"WITH {ARTICLE} SELECT page_id, url, description FROM found",
        "store_upsert": f"""WITH {OPP}, {INCOMING}, {MERGED}
            SELECT source_hash, id, designation, md5(job_description) AS description_digest, location, company_name, source_url,
              relevant, {stamp('date_posted')} AS date_posted, applied, {stamp('applied_date')} AS applied_date, resume_version_used
            FROM merged""",
        "store_dedup": f"WITH {OPP}, {INCOMING} SELECT DISTINCT sha256(source_url) AS source_hash FROM inc WHERE source_url <> ''",
        "missing_values": f"""WITH {OPP}, {INCOMING} SELECT
            {', '.join(f"count(*) FILTER (WHERE {blank(c)}) AS {c}" for c in ('designation', 'job_description', 'location', 'company_name'))},
            {', '.join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in ('relevant', 'applied', 'applied_date'))} FROM inc""",
        "missing_desc_targets": f"""WITH {OPP} SELECT doc_pos, source_url FROM opp
            WHERE source_url <> '' AND {domain('source_url')} = 'jobs.example.com' AND {blank('job_description')}""",
        "backfill_stats": f"""WITH {OPP}, {INCOMING}, {ARTICLE},
            st AS (SELECT DISTINCT id, source_url FROM inc WHERE source_url <> ''),
            body AS (SELECT id, source_url, CASE WHEN id LIKE 'in-%' THEN 'x' END AS jd FROM st),
            o AS (SELECT source_url, description FROM body LEFT JOIN found ON url = source_url WHERE jd IS NULL)
            SELECT (SELECT count(*) FROM body) AS total,
              (SELECT count(*) FROM body WHERE jd IS NULL AND {domain('source_url')} = 'jobs.example.com') AS eligible,
              count(*) FILTER (WHERE description IS NOT NULL) AS updated, count(*) FILTER (WHERE source_url = '') AS skipped,
              count(*) FILTER (WHERE source_url <> '' AND description IS NULL) AS failed FROM o""",
        "backfill_fill": f"""WITH {OPP}, {INCOMING}, {ARTICLE},
            best AS (SELECT url, arg_min(description, page_id) AS description FROM found WHERE description IS NOT NULL GROUP BY url),
            st AS (SELECT source_url, max(job_description) AS jd FROM inc WHERE source_url <> '' GROUP BY source_url)
            SELECT source_url, md5(coalesce(jd, description)) AS digest FROM st LEFT JOIN best ON url = source_url""",
        "verify_missing": f"""WITH {OPP}, {INCOMING}, {MERGED}
            SELECT DISTINCT source_url FROM opp WHERE {domain('source_url')} = 'jobs.example.com' AND {blank('job_description')}
              AND source_url NOT IN (SELECT source_url FROM merged WHERE NOT {blank('job_description')})""",
        "json_records": f"""WITH {OPP} SELECT id, designation, md5(job_description) AS digest, company_name, source_url, relevant,
            {stamp('date_posted')} AS date_posted, applied, {stamp('applied_date')} AS applied_date FROM opp""",
        "snapshot_store": f"""WITH {OPP}, {INCOMING}, {MERGED}
            SELECT source_hash, id, location, relevant, applied, resume_version_used FROM merged""",
        "stopword_table": "SELECT DISTINCT lower(trim(regexp_replace(p_type, ' +', ' ', 'g'))) AS term FROM part",
        "status_table": f"""SELECT conv_id, turn, role AS section, {statuses('conv_id')} AS status,
            {stamp('make_timestamp((1704067200 + conv_id * 3600) * 1000000)')} AS last_updated FROM conversations""",
        "status_files": f"""SELECT role || '-' || turn AS section, {statuses('conv_id')} AS status,
            {stamp('make_timestamp((1704067200 + conv_id * 3600) * 1000000)')} AS last_updated, conv_id || '-' || turn AS filename FROM conversations""",
        "resume_files": f"WITH {RESUME} SELECT resume_id, md5(body) AS digest, TRUE AS dated FROM res",
        "tracker_counts": f"""WITH {OPP} SELECT count(*) AS total, count(*) FILTER (WHERE applied) AS applied,
            count(*) FILTER (WHERE NOT applied) AS not_applied FROM opp""",
        "tracker_view": f"""WITH {OPP} SELECT row_number() OVER (ORDER BY coalesce(relevant, false) DESC, applied ASC, date_posted DESC, doc_pos) AS place,
            doc_pos, designation AS title, coalesce(source_url, '') AS url, company_name AS company, location, {stamp('date_posted')} AS date_posted,
            CASE WHEN job_description <> '' THEN CASE WHEN length(job_description) > 200 THEN left(job_description, 200) || '...' ELSE job_description END END AS preview,
            coalesce(length(job_description) > 200, false) AS shortened, coalesce(relevant, false) AS relevant, applied
            FROM opp WHERE designation <> '' AND company_name <> ''""",
        "can_tailor": f"WITH {OPP} SELECT doc_pos, length(job_description) AS n_chars FROM opp WHERE job_description <> ''",
        "status_fold": STATUS,
        "status_restart": STATUS,
        "status_stream": STATUS,
        "tfidf": f"""{CORPUS} SELECT doc_id, count(*) AS terms, round(sum(w), 6) AS total, round(max(w), 6) AS largest,
            CAST(sum(df) AS BIGINT) AS df_sum, round(sum(w * length(term)), 5) AS checksum FROM w GROUP BY doc_id""",
        "copies": f"""WITH {prepared('documents')}
            SELECT doc_id, min(doc_id) OVER k AS leaf, count(*) OVER k AS copies FROM prep WINDOW k AS (PARTITION BY array_to_string(tokens, ' '))""",
        "nearest_documents": f"""{CORPUS}, {LEAVES},
            pair AS (SELECT a.leaf, b.leaf AS other, sum(a.w * b.w) AS sim FROM lw a JOIN lw b ON a.term = b.term AND a.leaf <> b.leaf GROUP BY ALL)
            SELECT leaf, round(1 - max(sim), 6) AS distance FROM pair GROUP BY leaf""",
        "merge_tree": f"""{CLUSTERING}
            SELECT gone, keep, round(distance, 6) AS distance FROM tree""",
        "cluster_run": f"""{CLUSTERING}, {CHOICE.format(minimum="4")},
            cut AS (SELECT leaf, label, n, n >= least AS large FROM lab JOIN chosen USING (idx) JOIN csize USING (idx, label), total),
            dots AS (SELECT leaf, label, dot FROM prods JOIN chosen USING (idx)),
            lengths AS (SELECT label, sqrt(sum(copies * dot)) AS l FROM cut JOIN dots USING (leaf, label) JOIN leaf USING (leaf) WHERE large GROUP BY label),
            pick AS (SELECT d.leaf, arg_max(d.label, (round(dot / l, 12), -d.label)) AS label FROM dots d JOIN lengths USING (label) JOIN cut c ON c.leaf = d.leaf
                     WHERE NOT c.large AND round(dot / l, 12) > 0 GROUP BY d.leaf),
            fin AS (SELECT leaf, CASE WHEN large OR NOT EXISTS (FROM cut WHERE large) THEN c.label ELSE coalesce(p.label, (SELECT min(label) FROM cut WHERE large)) END AS label
                    FROM cut c LEFT JOIN pick p USING (leaf)),
            clustered AS (SELECT doc_id, label AS cluster_id FROM prep JOIN leaf ON k = array_to_string(tokens, ' ') JOIN fin USING (leaf)),
            {cluster_terms(label="clustered")},
            line AS (SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) AS words FROM kr WHERE rank <= 24 GROUP BY cluster_id)
            SELECT cluster_id, count(*) AS total_opportunities, coalesce(any_value(words), 'No keywords available.') AS keyword_line,
              (SELECT count(DISTINCT cluster_id) FROM clustered) AS discovered_k, any_value(chosen.k) AS natural_discovered_k
            FROM clustered LEFT JOIN line USING (cluster_id), chosen GROUP BY cluster_id""",
        "natural_cut": f"""{CLUSTERING}, {CHOICE.format(minimum='greatest(3, ceil(sum(copies) * 0.05::DOUBLE))')}
            SELECT leaf, label, k, round(threshold, 6) AS threshold, CAST(least AS BIGINT) AS minimum FROM lab JOIN chosen USING (idx), total""",
        "cosine_pairs": f"""{CORPUS}, {LEAVES},
            pair AS (SELECT a.leaf AS a, b.leaf AS b, sum(a.w * b.w) AS sim FROM lw a JOIN lw b ON a.term = b.term AND a.leaf < b.leaf GROUP BY ALL)
            SELECT a, b, round(1 - sim, 6) AS distance FROM pair WHERE sim >= 0.25""",
        "silhouette": f"{GIVEN} SELECT grp, label, count(*) AS n, round(avg(v), 6) AS silhouette FROM silh GROUP BY ALL",
        "candidate_scores": f"""{GIVEN},
            prof AS (SELECT grp, count(*) AS k, max(n) / (SELECT n FROM ndocs) AS largest,
                       coalesce(sum(n) FILTER (WHERE n < {Q.MIN_SIZE}), 0) / (SELECT n FROM ndocs) AS tiny FROM size GROUP BY grp)
            SELECT grp, k, round(avg(v), 6) AS silhouette, round(avg(v) - 0.35::DOUBLE * max(largest) - 0.20::DOUBLE * max(tiny), 6) AS score
            FROM silh JOIN prof USING (grp) GROUP BY grp, k""",
        "cluster_sizes": f"{GIVEN} SELECT label, n, n >= {Q.MIN_SIZE} AS major FROM size WHERE grp = 0",
        "centroids": f"""{GIVEN} SELECT grp, label, n, round(sqrt(coalesce(sum(s * s), 0)) / n, 6) AS length
            FROM size LEFT JOIN csum USING (grp, label) GROUP BY grp, label, n""",
        "reassign_tiny": f"""{GIVEN},
            major AS (SELECT label FROM size WHERE grp = 0 AND n >= {Q.MIN_SIZE}),
            tiny AS (SELECT doc_id FROM labels2 WHERE grp = 0 AND label NOT IN (SELECT label FROM major) AND EXISTS (FROM major)),
            len AS (SELECT label, sqrt(sum(s * s)) AS l FROM csum WHERE grp = 0 GROUP BY label),
            near AS (SELECT doc_id, other, round(dot / l, 12) AS sim FROM xs JOIN len ON len.label = other
                     WHERE grp = 0 AND other IN (SELECT label FROM major) AND doc_id IN (SELECT doc_id FROM tiny)),
            pick AS (SELECT doc_id, arg_max(other, (sim, -other)) AS label FROM near WHERE sim > 0 GROUP BY doc_id)
            SELECT l.doc_id, CASE WHEN t.doc_id IS NULL THEN l.label ELSE coalesce(p.label, (SELECT min(label) FROM major)) END AS label,
              (SELECT count(*) FROM tiny) AS moved
            FROM labels2 l LEFT JOIN tiny t USING (doc_id) LEFT JOIN pick p USING (doc_id) WHERE grp = 0""",
        "cut_distances": """WITH d AS (SELECT DISTINCT o_totalprice / 1000 AS distance FROM orders),
            p AS (SELECT distance, row_number() OVER (ORDER BY distance) - 1 AS place, count(*) OVER () AS total FROM d),
            s AS (SELECT *, CASE WHEN total <= 30 THEN 1 ELSE total // 30 END AS step FROM p)
            SELECT place // step + 1 AS idx, distance FROM s WHERE place % step = 0 AND place // step < 30""",
        "cut_labels": """WITH RECURSIVE t AS (SELECT * FROM (VALUES (0::BIGINT, 0.08::DOUBLE), (1, 0.11), (2, 0.3), (3, 0.9)) v(grp, t)),
            walk AS (SELECT grp, t, o_orderkey AS leaf, o_orderkey AS label, 0 AS depth FROM orders, t
              UNION ALL SELECT grp, t, leaf, label // 2, depth + 1 FROM walk WHERE label > 0 AND 1.0::DOUBLE / (1 + length(bin(label))) < t)
            SELECT grp, leaf, arg_max(label, depth) AS label FROM walk GROUP BY grp, leaf""",
        "cluster_sentences": f"{SENTENCE_RANK} SELECT cluster_id, rank, sentence, hits FROM srank WHERE rank <= 20",
        "cluster_summary": f"""{SUMMARY} SELECT cluster_id, total_opportunities, first_doc,
            CASE WHEN len(keywords) = 0 THEN 'No keywords available.' ELSE array_to_string(keywords[1:24], ', ') END AS keyword_line,
            {digest('sentences')} AS sentences_digest FROM summ""",
        "cluster_tables": f"""WITH {SUMMARY_DOCS}, {prepared('odocs')}, {cluster_terms()},
            k AS (SELECT cluster_id, CAST(sum(rank * length(term)) AS BIGINT) AS checksum FROM kr GROUP BY cluster_id)
            SELECT cluster_id, count(*) AS total_opportunities, count(source_url) AS with_url, any_value(checksum) AS checksum,
              '{Q.NOW}' AS generated_at, (SELECT count(DISTINCT cluster_id) FROM lab) AS discovered_k, {len(SINGLES + PHRASES)}::BIGINT AS n_stopwords
            FROM lab JOIN opp ON doc_pos = doc_id JOIN k USING (cluster_id) GROUP BY cluster_id""",
        "report_sentences": f"""{SUMMARY} SELECT cluster_id, line_no, line FROM (
              SELECT cluster_id, generate_subscripts(sentences, 1) AS line_no, generate_subscripts(sentences, 1) || '. ' || unnest(sentences) AS line FROM summ
              UNION ALL SELECT cluster_id, 1, 'No keyword-matching sentences available.' FROM summ WHERE len(sentences) = 0)""",
        "report_rows": f"""WITH {OPP}, {LAB}
            SELECT cluster_id, doc_pos, coalesce(designation, 'None') AS designation,
              CASE WHEN coalesce(company_name, '') = '' THEN 'Unknown company' ELSE company_name END AS company_name,
              coalesce(source_url, 'n/a') AS url FROM lab JOIN opp ON doc_pos = doc_id
            UNION ALL SELECT n_nationkey + 1000, NULL, 'No opportunities attached.', 'n/a', 'n/a' FROM nation""",
        "report_overview": "SELECT count(DISTINCT source) AS detected_clusters FROM documents",
        "freshness": """SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY) AS fresh,
            count(*) AS total FROM orders GROUP BY o_orderpriority""",
        "due_outputs": f"""SELECT c_custkey AS output, {stamp('max(o_orderdate)')} AS generated_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey
            GROUP BY c_custkey HAVING max(o_orderdate) IS NULL OR max(o_orderdate) < TIMESTAMP '1998-06-01' - INTERVAL 30 DAY""",
        "forced_outputs": f"""SELECT c_custkey AS output, {stamp('max(o_orderdate)')} AS generated_at,
              coalesce(max(o_orderdate) >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY, false) AS fresh
            FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
        "display_time": f"""WITH t AS (SELECT o_orderkey, o_orderkey % 13 AS k, {stamp('o_orderdate')} AS s, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, o_orderpriority FROM orders)
            SELECT o_orderkey, CASE k WHEN 0 THEN s || ' ' WHEN 1 THEN s || ' UTC' WHEN 2 THEN s || ' UTC+05:30' WHEN 3 THEN s || ' UTC' WHEN 4 THEN s || ' UTC-08:00'
              WHEN 5 THEN left(iso, 4) WHEN 6 THEN left(iso, 7) WHEN 7 THEN left(s, 10) || ' 00:00:00 ' WHEN 8 THEN left(s, 16) || ':00 ' WHEN 9 THEN substr(iso, 12, 5)
              WHEN 10 THEN left(s, 10) || ' 00:00:00 ' WHEN 11 THEN o_orderpriority ELSE 'Unknown' END AS shown FROM t""",
        "status_current": f"""WITH part AS (
              SELECT user_id, event_id % 2 AS b,
                arg_max(event_type = 'view', (ts, event_id)) FILTER (WHERE event_type IN ('view', 'click')) AS relevant,
                arg_max(event_type = 'purchase', (ts, event_id)) FILTER (WHERE event_type IN ('purchase', 'error')) AS applied,
                arg_max(ts, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS at
              FROM events GROUP BY ALL)
            SELECT CAST(u.user_id AS VARCHAR) AS user_id, coalesce(y.relevant, x.relevant) AS relevant, coalesce(y.applied, false) AS applied,
              {stamp('coalesce(y.at, x.at)')} AS applied_date
            FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN part x ON x.user_id = u.user_id AND x.b = 0 LEFT JOIN part y ON y.user_id = u.user_id AND y.b = 1""",
        "lexicon_tokens": f"""WITH {LEMMAS} SELECT doc_id, len(tokens) AS n_tokens, len(keywords) AS n_keywords, {digest('tokens')} AS tokens_digest,
              {digest('keywords')} AS keywords_digest FROM lex""",
        "dynamic_default": """WITH d AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), ''), lambda c: c <> ''))) AS term FROM documents)
            SELECT term, count(*) AS df FROM d GROUP BY term
            HAVING count(*) >= greatest(2, ceil((SELECT count(*) FROM documents) * CASE WHEN (SELECT count(*) FROM documents) >= 10 THEN 0.6 ELSE 0.75 END))""",
        "json_store": f"WITH {OPP} SELECT id, designation, md5(job_description) AS description_digest, source_url, applied FROM opp WHERE source_url IS NOT NULL",
        "json_object": f"WITH {OPP} SELECT id, designation, source_url, applied FROM opp WHERE source_url IS NOT NULL",
        "default_values": f"""WITH {OPP}, {INCOMING} SELECT pos, id, CASE WHEN location = 'remote' THEN {stamp('date_posted')} ELSE '{Q.NOW}' END AS date_posted, false AS applied FROM inc""",
        "selector_table": """SELECT c_name AS domain, unnest(['container', 'description', 'paged']) AS field, unnest([c_mktsegment, c_mktsegment || '|' || c_name, 'true']) AS selectors
            FROM customer""",
        "last_run": f"""SELECT o_orderpriority, count(*) AS n, (SELECT {stamp('max(o_orderdate)')} FROM orders WHERE o_orderkey % 3 <> 0) AS last FROM orders GROUP BY 1""",
        "merge_heights": """WITH d AS (SELECT DISTINCT round(1 / (1 + length(bin(o_orderkey))), 9) AS distance FROM orders WHERE o_orderkey > 0)
            SELECT 'whole' AS tree, distance FROM d UNION ALL SELECT 'parts', distance FROM (SELECT distance FROM d UNION SELECT 1.0)""",
        "cluster_sentences_lexicon": f"""WITH {LEMMAS}, {LAB},
            {cluster_terms('(SELECT doc_id, keywords FROM lex)').replace(f" HAVING term NOT IN {words(SINGLES + PHRASES)}", "")}, {sentence_ctes('(SELECT doc_id, text FROM documents)')},
            folded AS (SELECT cluster_id, sentence FROM sent JOIN lab USING (doc_id) GROUP BY ALL),
            stok AS (SELECT cluster_id, sentence, {lemma_list('sentence')} AS toks FROM folded),
            sgram AS (SELECT DISTINCT cluster_id, sentence, term FROM (SELECT cluster_id, sentence, unnest({gram_list('toks')}, recursive := true) FROM stok)),
            hit AS (SELECT cluster_id, sentence, count(*) AS hits FROM sgram JOIN kt USING (cluster_id, term) GROUP BY ALL)
            SELECT cluster_id, count(*) AS sentences, CAST(sum(hits) AS BIGINT) AS hits, max(hits) AS most FROM hit GROUP BY cluster_id""",
        "nested_members": f"""WITH {SUMMARY_DOCS}, {prepared('odocs')}, {cluster_terms()},
            k AS (SELECT cluster_id, count(*) AS n_keywords, arg_min(term, rank) AS best FROM kr GROUP BY 1),
            c AS (SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS place FROM lab GROUP BY 1)
            SELECT place, cluster_id, coalesce(n_keywords, 0) AS n_keywords, best, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) - 1 AS i, 'op-' || doc_id AS id
            FROM lab JOIN c USING (cluster_id) LEFT JOIN k USING (cluster_id)""",
        "resume_sections": f"WITH {RESUME}, {SECTION_ROWS} SELECT resume_id, ord, section, body FROM secs",
        "resume_prompts": f"{PROMPTS} SELECT prompt_id, resume_id, job_id, section, ord, md5(prompt) AS digest FROM prm",
        "resume_every_job": EVERY_JOB,
        "resume_pairs": RESUME_PAIRS,
        "header_prompts": f"""WITH {RESUME}, p AS (SELECT resume_id, {lit(before)} || body || {lit(after)} AS prompt FROM res)
            SELECT resume_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM p""",
        "resume_assembly": f"""{PROMPTS},
            part AS (
              SELECT resume_id, job_id, ord, '# USER' || chr(10) || CASE WHEN length(prompt) % 13 = 0 THEN '' ELSE lower(prompt) END AS body FROM prm
              UNION ALL SELECT p.resume_id, p.job_id, s.ord, s.body FROM prm p JOIN secs s USING (resume_id) WHERE s.section <> 'user'),
            whole AS (SELECT resume_id, job_id, string_agg(body, chr(10) || chr(10) ORDER BY ord) AS r FROM part WHERE body <> '' GROUP BY ALL)
            SELECT resume_id, job_id, md5(r) AS digest, length(r) AS n_chars FROM whole""",
        "stale_sections": f"""SELECT conv_id, turn, role AS section, {statuses('conv_id')} AS status FROM conversations
            WHERE NOT ({statuses('conv_id')} = 'Completed' AND conv_id // 24 >= 2)""",
        "section_updates": f"""SELECT conv_id, turn,
            CASE WHEN length(text) % 5 = 0 THEN 'Failed' ELSE 'Completed' END AS status, '{Q.NOW}' AS last_updated,
            CASE WHEN length(text) % 5 <> 0 THEN md5(text) END AS digest FROM conversations""",
        "failed_sections": "SELECT role AS section, count(*) AS failed FROM conversations WHERE conv_id % 4 = 3 GROUP BY role",
        "build_succeeded": """SELECT count(*) FILTER (WHERE conv_id % 4 = 3) AS failed, count(*) FILTER (WHERE conv_id % 4 = 3) = 0 AS succeeded
            FROM conversations""",
    }
