"""Expected answers of the text queries that SQL can express, for DuckDB."""

from __future__ import annotations

from sitefold.llm import collocations, licenses, secrets, vector_codes


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def license_scan() -> str:
    """Word pairs against template pairs, diagonals, runs of neighbouring diagonals."""
    pairs = []
    for number, phrase in enumerate([*licenses.BASE, *licenses.TEMPLATES]):
        words = phrase.split(" ")
        label = {**licenses.BASE, **licenses.TEMPLATES}[phrase]
        pairs += [
            f"({number}, {_q(label)}, {phrase in licenses.BASE}, {len(words) - 1}, {at}, {_q(words[at])}, {_q(words[at + 1])})"
            for at in range(len(words) - 1)
        ]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    slack = licenses.SLACK
    return f"""
WITH t(template, label, base, pairs, t_at, w1, w2) AS (VALUES {", ".join(pairs)}),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words
  FROM documents),
p AS (SELECT doc_id, unnest(range(len(words) - 1)) AS place, words FROM w WHERE len(words) > 1),
h AS (SELECT doc_id, template, label, base, pairs, t_at, place, place - t_at AS diagonal
      FROM p JOIN t ON words[place + 1] = w1 AND words[place + 2] = w2),
d AS (SELECT doc_id, template, label, base, pairs, diagonal, list(DISTINCT t_at) AS seen,
             min(place) AS low, max(place) AS high
      FROM h GROUP BY ALL),
f AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER o > {slack} OR low - lag(high) OVER o > {slack} + 1, false) AS far
      FROM d WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
g AS (SELECT *, sum(far::int) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM f),
c AS (SELECT doc_id, template, label, base, pairs, len(list_distinct(flatten(list(seen)))) / pairs AS cover,
             sum((base AND len(seen) = pairs)::int) AS places,
             min(CASE WHEN base AND len(seen) = pairs THEN diagonal END) AS low,
             max(CASE WHEN base AND len(seen) = pairs THEN diagonal END) AS high
      FROM g GROUP BY doc_id, template, label, base, pairs, part),
s AS (SELECT *, CASE WHEN base THEN CASE WHEN places > 0 THEN 1.0 END
                     WHEN cover >= {licenses.LEAST_COVER} THEN cover END AS shown FROM c),
a AS (SELECT doc_id, sum(places) AS n_base, min(low) AS first_word, max(high) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND places > 0) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (shown IS NOT NULL) AS labels,
             max(shown) AS score
      FROM s GROUP BY doc_id)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base,
       first_word::bigint AS first_word, last_word::bigint AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::double AS score
FROM w LEFT JOIN a USING (doc_id)"""


def secret_scan() -> str:
    """Matches and the pieces between them give places; owners are counted by value."""
    kinds = []
    for number, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        # the value of a match: the whole of it or its group
        value = f"regexp_extract(m, {_q(pattern)}, {group})" if group else "m"
        kinds.append(f"""
  SELECT doc_id, owner, repository, {number} AS kind_no, {_q(kind)} AS kind, k, length(p) AS gap, length(m) AS size,
         CASE WHEN length({value}) >= {least} THEN {value} END AS value
  FROM (SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository,
               unnest(range(len(ms))) AS k, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p
        FROM (SELECT doc_id, source, lang, regexp_extract_all(text, {_q(pattern)}) AS ms,
                     regexp_split_to_array(text, {_q(pattern)}) AS ps FROM documents))""")
    return f"""
WITH m AS ({" UNION ALL ".join(kinds)}),
s AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind_no ORDER BY k) AS stop FROM m),
n AS (SELECT lower(value) AS v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM m WHERE value IS NOT NULL GROUP BY 1),
l AS (SELECT s.*, stop - size AS start, owners, repositories,
             owners > {secrets.MAX_OWNERS} OR repositories > {secrets.MAX_REPOSITORIES} AS copied,
             NOT copied AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
             AND len(list_distinct(string_split(value, ''))) >= {secrets.LEAST_CHARACTERS} AS live,
             regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AS mixed
      FROM s JOIN n ON lower(value) = v WHERE value IS NOT NULL),
x AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM l WHERE kind <> 'opaque' OR (live AND mixed)),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(secrets.BASE)}) AS base,
             string_agg(span, ',' ORDER BY start, kind_no) AS spans,
             string_agg(span, ',' ORDER BY start, kind_no) FILTER (live) AS live_spans,
             count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_example,
             max(owners) AS owners, max(repositories) AS repositories
      FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(live_spans, '') AS live_spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
       coalesce(owners, 0) AS owners, coalesce(repositories, 0) AS repositories
FROM documents LEFT JOIN a USING (doc_id)"""


def vector_code_rounds(dimension: int = 64) -> str:
    """Every part against every entry, in each round; codebooks by position of the part."""
    parts, width = vector_codes.PARTS, dimension // vector_codes.PARTS
    at = range(width)
    cols = ", ".join(f"v{k}" for k in at)
    gap = " + ".join(f"(x.v{k} - b.v{k}) * (x.v{k} - b.v{k})" for k in at)

    def near(book: str) -> str:  # distance and index in one number: ties go to the lower index
        return f"""SELECT x.vec_id, x.label, x.p, {", ".join(f"any_value(x.v{k}) AS v{k}" for k in at)},
  min(({gap}) * 256 + b.e) AS best FROM x JOIN {book} b ON x.p = b.p GROUP BY x.vec_id, x.label, x.p"""

    def mean(k: int) -> str:  # floor(sum / count), the sum may be negative
        return f"((sum(v{k}) - ((sum(v{k}) % count(*)) + count(*)) % count(*)) // count(*))::bigint AS v{k}"

    steps = ""
    for n in range(vector_codes.ROUNDS):
        steps += f"""
a{n} AS MATERIALIZED ({near(f"b{n}")}),
m{n} AS (SELECT p, best % 256 AS e, {", ".join(map(mean, at))} FROM a{n} GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, {", ".join(f"coalesce(m.v{k}, b.v{k}) AS v{k}" for k in at)}
  FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.e),"""
    last = f"b{vector_codes.ROUNDS}"
    listed = " || ',' || ".join(f"v{k}" for k in at)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor({vector_codes.SCALE} * v::double)::bigint) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, label, p, {", ".join(f"c[p * {width} + {k + 1}] AS v{k}" for k in at)}
  FROM kept, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, {cols}
  FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {vector_codes.ENTRIES})),{steps}
z AS ({near(last)}),
r AS (SELECT vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256) AS error
      FROM z GROUP BY vec_id, label)
SELECT vec_id, code, error::bigint AS error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
       (SELECT sha256(string_agg({listed}, ',' ORDER BY p, e)) FROM {last}) AS codebooks_sha256
FROM r"""


def phrase_mining() -> str:
    """All phrases counted, then cut, compared with longer ones and ranked."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    longest, least = collocations.MOST_WORDS, collocations.LEAST_COUNT
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS words, unnest(list_transform(range(1, len(ws) - {n - 2}), "
        f"lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS phrase FROM w WHERE len(ws) >= {n}"
        for n in range(1, longest + 1)
    )
    cuts = " UNION ALL ".join(
        f"SELECT lang, words, phrase, n AS a, {k} AS cut, array_to_string(string_split(phrase, ' ')[1:{k}], ' ') AS p1, "
        f"array_to_string(string_split(phrase, ' ')[{k + 1}:words], ' ') AS p2 FROM f WHERE words > {k}"
        for k in range(1, longest)
    )
    inner = " UNION ALL ".join(
        f"SELECT lang, n, array_to_string(string_split(phrase, ' ')[{at}:{at + size - 1}], ' ') AS phrase "
        f"FROM f WHERE words >= {at + size - 1} AND words > {size}"
        for size in range(2, longest) for at in range(1, longest - size + 2)
    )
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{collocations.NO_LANG}') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
g AS ({grams}),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= {least}),
c AS ({cuts}),
s AS (SELECT c.lang, c.words, c.phrase, a, cut, x.n AS l, y.n AS r,
             (1000000::hugeint * a * a) // (x.n::hugeint * y.n) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = p1 JOIN f y ON y.lang = c.lang AND y.phrase = p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(n) AS longer FROM ({inner}) GROUP BY ALL),
k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
      WHERE longer IS NULL OR 100 * longer < {collocations.COVERED} * a)
SELECT k.lang, rank, phrase, a, l, r, t.n::bigint AS n, score::bigint AS score
FROM k JOIN (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang) t ON t.lang = k.lang
WHERE rank <= {collocations.TOP}"""


def statements() -> dict[str, str]:
    return {
        "op3_secret_scan": secret_scan(),
        "op4_exact_dedup": EXACT_DEDUP,
        "op9_license_scan": license_scan(),
        "op11_vector_codes": vector_code_rounds(),
        "op12_collocations": phrase_mining(),
    }
