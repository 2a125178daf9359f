"""DuckDB SQL with the same outcome as the query of the same name."""

import re

from checks.inputs import SEED_CONFUSIONS
from misheard.functions import text

ORACLES: dict = {}

KEEP = "[^ ''a-zàáèéìíòóùúš]"


def purify(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{KEEP}', '', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def marked(c: str) -> str:
    return f"list_concat(['[START]'], {words(c)}, ['[END]'])"


def row_seed(seed: int, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"{k}::VARCHAR" for k in keys]])
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def with_draw(source: str, rs: str, k: str, name: str = "r", slot: int = 0) -> str:
    """SELECT *, draw AS name, in steps so that no term is written twice."""
    m = "4294967295"
    return f"""(SELECT * EXCLUDE (_x, _y, _z), xor(_z, _z >> 16) AS {name} FROM (
      SELECT *, (xor(_y, _y >> 16) * 73244475) & {m} AS _z FROM (
      SELECT *, (xor(_x, _x >> 16) * 73244475) & {m} AS _y FROM (
      SELECT *, ({rs} + ({k})::BIGINT * 2654435761 + {slot * 40503 * 65537}) & {m} AS _x FROM {source}))))"""


def with_wide_draw(source: str, rs: str, k: str) -> str:
    two = with_draw(with_draw(source, rs, k, "r0"), rs, k, "r1", 1)
    return f"(SELECT * EXCLUDE (r0, r1), r0 * 2147483648 + (r1 & 2147483647) AS r FROM {two})"


LINES = r"""lines AS (
  SELECT doc_id, unnest(parts) AS line, (generate_subscripts(parts, 1) - 1)::INTEGER AS line_no
  FROM (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts
        FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS p FROM {docs} WHERE length(text) > 0)))"""

SPLIT = r"""split AS (
  SELECT doc_id, line_no, unnest(parts) AS sentence, (generate_subscripts(parts, 1) - 1)::INTEGER AS sent_no
  FROM (SELECT doc_id, line_no,
          string_split(regexp_replace(line, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM lines))"""


def sentences(docs: str = "documents") -> str:
    return (
        LINES.replace("{docs}", docs) + ", " + SPLIT + f""", sentences AS (
  SELECT * FROM (SELECT doc_id, line_no, sent_no, {purify('sentence')} AS sentence FROM split)
  WHERE len({words('sentence')}) > 3)"""
    )


SENT = sentences()

TURNS = f"""turns AS (
  SELECT * FROM (
    SELECT conv_id, turn, ref, lead(ref) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp
    FROM (SELECT conv_id, turn, {purify('text')} AS ref FROM conversations)) WHERE hyp IS NOT NULL)"""

PADDED = TURNS + """, padded AS (
  SELECT conv_id, turn, rpad(ref, greatest(length(ref), length(hyp))::INTEGER, '?') AS ref_aln,
         rpad(hyp, greatest(length(ref), length(hyp))::INTEGER, '?') AS hyp_aln FROM turns)"""


def wins(n_min: int, n_max: int, source: str = "padded", name: str = "wins") -> str:
    """Windows over character lists: the longest one per place is joined once,
    the shorter ones are its beginnings."""
    return f"""chars_{name} AS (
  SELECT *, string_split(ref_aln, '') AS _r, string_split(hyp_aln, '') AS _h, length(ref_aln) AS _n FROM {source}),
longest_{name} AS (
  SELECT conv_id, turn, "at", _n - "at" + 1 AS _left, array_to_string(_r["at":"at" + {n_max - 1}], '') AS _rw,
         array_to_string(_h["at":"at" + {n_max - 1}], '') AS _hw
  FROM (SELECT *, unnest(range(1, _n + 1)) AS "at" FROM chars_{name})),
{name} AS (
  SELECT conv_id, turn, n, "at", substr(_rw, 1, n) AS ref_win, substr(_hw, 1, n) AS hyp_win
  FROM longest_{name}, (SELECT unnest(range({n_min}, {n_max + 1})) AS n) AS orders WHERE _left >= n)"""


def forward(source: str = "wins") -> str:
    return f"""SELECT replace(ref_win, '?', '') AS chunk, replace(hyp_win, '?', '') AS replacement, count(*) AS cnt
  FROM {source} WHERE ref_win <> '?' GROUP BY ALL"""


def reverse(source: str = "wins") -> str:
    return f"""SELECT replace(hyp_win, '?', '') AS chunk, replace(ref_win, '?', '') AS replacement, count(*) AS cnt
  FROM {source} WHERE replace(hyp_win, '?', '') <> '' GROUP BY ALL"""


CONFUSIONS = PADDED + ", " + wins(1, 3) + ", confusions AS MATERIALIZED (" + forward() + ")"
CANDIDATES = """cands AS MATERIALIZED (
  SELECT chunk, replacement AS repl, sum(cnt) OVER w - cnt AS lo, sum(cnt) OVER w AS hi,
         sum(cnt) OVER (PARTITION BY chunk) AS total
  FROM confusions WINDOW w AS (PARTITION BY chunk ORDER BY replacement ROWS UNBOUNDED PRECEDING))"""
SEEDS = "confusions AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', {})".format(a.replace("'", "''"), b.replace("'", "''"), n) for a, b, n in SEED_CONFUSIONS
) + ") AS t(chunk, replacement, cnt))"

_LETTERS = "".join(chr(ord("g") + i % 4) for i in range(16))


def chunks(source: str, keys: list, text: str, seed: int, name: str = "chunked") -> str:
    """Chunk lengths from hex digits, running sums as a window over them."""
    k = ", ".join(keys)
    return f"""seeded_{name} AS (SELECT {k}, {text} AS _t, {row_seed(seed, *keys)} AS rs FROM {source}),
digits_{name} AS (
  SELECT {k}, rs, (unnest(ds) - 1 + 1) AS size, generate_subscripts(ds, 1) AS d FROM (
    SELECT {k}, rs, list_transform(string_split(translate(array_to_string(list_transform(range(0, length(_t) // 32 + 1),
        lambda b: md5(rs::VARCHAR || '|' || b::VARCHAR)), ''), '0123456789abcdef', '1234123412341234'), ''),
        lambda c: c::INTEGER) AS ds FROM seeded_{name})),
ends_{name} AS (
  SELECT *, sum(size) OVER (PARTITION BY {k} ORDER BY d ROWS UNBOUNDED PRECEDING) - size AS start FROM digits_{name}),
{name} AS (
  SELECT {k}, e.rs, (d - 1)::INTEGER AS k, e.start, substr(_t, (e.start + 1)::BIGINT, size::BIGINT) AS chunk
  FROM ends_{name} e JOIN seeded_{name} s USING ({k}) WHERE e.start < length(_t))"""


def corrupted(source: str, keys: list, text: str, seed: int, truncate: int | None = None) -> str:
    """Needs `confusions`; yields noisy(keys, text, corrupted)."""
    k = ", ".join(keys)
    kept = "chunk" if truncate is None else f"substr(chunk, 1, {truncate})"
    return (
        chunks(source, keys, text, seed)
        + ", "
        + CANDIDATES
        + f""", totals AS MATERIALIZED (SELECT DISTINCT chunk, total FROM cands),
picked AS (
  SELECT {k}, k, p.chunk, c.repl FROM (
    SELECT d.*, CASE WHEN total IS NOT NULL THEN r % total END AS pick_at
    FROM {with_wide_draw('chunked', 'rs', 'k')} d LEFT JOIN totals USING (chunk)) p
  LEFT JOIN cands c ON c.chunk = p.chunk AND p.pick_at >= c.lo AND p.pick_at < c.hi),
rebuilt AS (SELECT {k}, string_agg(coalesce(repl, {kept}), '' ORDER BY k) AS corrupted FROM picked GROUP BY ALL),
noisy AS (SELECT s.*, coalesce(corrupted, '') AS corrupted FROM {source} s LEFT JOIN rebuilt USING ({k}))"""
    )


SK = ["doc_id", "line_no", "sent_no"]

CLIPS = f"""labelled AS (
  SELECT 'clip_' || doc_id || '.mp3' AS path, text, source, doc_id AS src_row, quality, toxic
  FROM labels JOIN documents USING (doc_id)),
test AS (SELECT path, text AS sentence, src_row FROM labelled WHERE quality = 0 OR toxic = 1),
train AS (SELECT path, CASE WHEN toxic = 1 THEN source ELSE text END AS sentence, src_row FROM labelled WHERE quality = 1),
listed AS (SELECT *, 'test' AS split FROM test UNION ALL SELECT *, 'train' AS split FROM train),
actual AS (SELECT path, split, {purify('sentence')} AS sentence FROM listed
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY split <> 'test', src_row) = 1),
clips AS (SELECT 'clip_' || doc_id || '.mp3' AS path FROM documents),
heard AS (SELECT 'clip_' || doc_id || '.mp3' AS path,
  replace(translate({purify('text')}, 'eu', 'ao'), 'th ', 't') AS predicted FROM documents),
pairs AS (SELECT t.path, a.sentence AS ref, h.predicted AS hyp FROM test t JOIN actual a USING (path) JOIN heard h USING (path)),
ledger AS (SELECT 'clip_' || doc_id || '.mp3' AS key FROM labels WHERE quality = 1)"""

WINDOWS = f"""windows AS (
  SELECT doc_id, line_no, sent_no, unnest(ws) AS "window", (generate_subscripts(ws, 1) - 1)::INTEGER AS win_no FROM (
    SELECT *, CASE WHEN len(w) < 22 THEN [sentence] ELSE
      list_transform(range(0, greatest(ceil((len(w) - 22) / 11.0), 0)::BIGINT + 1),
        lambda i: array_to_string(w[i * 11 + 1:i * 11 + 22], ' ')) END AS ws
    FROM (SELECT *, {words('sentence')} AS w FROM sentences)))"""

# one round of the recursion is one row of the distance table of every pair
EDITS = f"""scored AS (SELECT *, {words('ref')} AS a, {words('hyp')} AS b FROM turns WHERE length(ref) > 4 AND length(hyp) > 4),
dp AS (
  SELECT conv_id, turn, 0 AS i, j, j AS d FROM (SELECT conv_id, turn, unnest(range(0, len(b) + 1)) AS j FROM scored)
  UNION ALL
  SELECT conv_id, turn, i, j, j + min(t - j) OVER (PARTITION BY conv_id, turn ORDER BY j) FROM (
    SELECT conv_id, turn, i + 1 AS i, j, least(d + 1, lag(d) OVER (PARTITION BY conv_id, turn ORDER BY j)
      + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END) AS t
    FROM dp JOIN scored USING (conv_id, turn) WHERE i < len(a))),
edits AS (SELECT conv_id, turn, d AS edits, len(a) AS ref_words
  FROM dp JOIN scored USING (conv_id, turn) WHERE i = len(a) AND j = len(b))"""


def aligned(source: str, keys: list, band: int | None, name: str) -> str:
    """name(keys, ref_aln, hyp_aln): the alignment of (ref, hyp), spelled out.

    `best[i + 1][j + 1]` is the largest number of links within ref[i:], hyp[j:],
    row by row from the last one; a walk from the start takes a link where it
    may, else moves on in ref if that keeps the largest number, else in hyp.
    Folds carry one type, so their elements are shaped like the state.
    """
    k = ", ".join(keys)
    near = "" if band is None else f" AND abs(i - j + 1) < {band}"
    near_walk = "" if band is None else f" AND abs(s.i - s.j) < {band}"
    return f"""padded_{name} AS (
  SELECT {k}, ref, hyp, n, string_split(rpad(ref, n, '?'), '') AS a, string_split(rpad(hyp, n, '?'), '') AS b
  FROM (SELECT *, greatest(length(ref), length(hyp))::INTEGER AS n FROM {source}) WHERE n > 0),
tables_{name} AS (
  SELECT *, list_reduce(
    list_prepend([list_transform(range(0, n + 1), lambda j: 0)], list_transform(range(n - 1, -1, -1), lambda i: [[i::INTEGER]])),
    lambda rows, e: list_prepend(
      list_transform(range(1, n + 2), lambda j: coalesce(list_max(
        list_transform(range(1, n + 1), lambda jj: CASE WHEN jj < j THEN 0
          WHEN a[e[1][1] + 1] = b[jj] {near.replace("i - j + 1", "e[1][1] - jj + 1")} THEN rows[1][jj + 1] + 1
          ELSE rows[1][jj] END)), 0)::INTEGER), rows)) AS best
  FROM padded_{name}),
walks_{name} AS (
  SELECT {k}, ref, hyp, n, a, b, list_reduce(
    list_transform(range(0, 2 * n + 1), lambda s: {{'i': 0, 'j': 0, 'links': [[0, 0]][:0]}}),
    lambda s, e: CASE WHEN best[s.i + 1][s.j + 1] = 0 THEN s
      WHEN a[s.i + 1] = b[s.j + 1]{near_walk} THEN {{'i': s.i + 1, 'j': s.j + 1, 'links': list_append(s.links, [s.i, s.j])}}
      WHEN best[s.i + 2][s.j + 1] = best[s.i + 1][s.j + 1] THEN {{'i': s.i + 1, 'j': s.j, 'links': s.links}}
      ELSE {{'i': s.i, 'j': s.j + 1, 'links': s.links}} END).links AS links
  FROM tables_{name}),
runs_{name} AS (
  SELECT *, coalesce(lag(i) OVER w + 1, 0) AS pi, coalesce(lag(j) OVER w + 1, 0) AS pj FROM (
    SELECT {k}, ref, hyp, n, a, b, unnest(list_append(links, [n, n])) AS l, l[1] AS i, l[2] AS j,
      generate_subscripts(list_append(links, [n, n]), 1) AS no FROM walks_{name})
  WINDOW w AS (PARTITION BY {k} ORDER BY no)),
sides_{name} AS (
  SELECT *, array_to_string(a[pi + 1:i], '') || repeat('?', greatest(j - i, 0)) AS x,
    array_to_string(b[pj + 1:j], '') || repeat('?', greatest(i - j, 0)) AS y FROM runs_{name}),
columns_{name} AS (
  SELECT *, list_filter(list_zip(string_split(lpad(x, w, '?'), ''), string_split(lpad(y, w, '?'), '')),
    lambda c: c[1] <> '?' OR c[2] <> '?') AS cols
  FROM (SELECT *, greatest(length(x), length(y))::INTEGER AS w FROM sides_{name})),
{name} AS (
  SELECT {k}, any_value(ref) AS ref, any_value(hyp) AS hyp,
    string_agg(coalesce(array_to_string(list_transform(cols, lambda c: c[1]), ''), '') || coalesce(a[i + 1], ''), '' ORDER BY no) AS ref_aln,
    string_agg(coalesce(array_to_string(list_transform(cols, lambda c: c[2]), ''), '') || coalesce(b[j + 1], ''), '' ORDER BY no) AS hyp_aln
  FROM columns_{name} GROUP BY ALL)"""


def _window(source: str) -> str:
    """`source` (with x and y of equal length w) and its alignment nx, ny, without
    rows of other tables, so that a recursion may use it. Gaps that are linked to
    each other go."""
    side = lambda s, p: f"""array_to_string(list_transform(range(1, len(links) + 2), lambda k: array_to_string(list_transform(
      list_filter(list_zip(string_split(lpad(runs[k].x, greatest(length(runs[k].x), length(runs[k].y))::INTEGER, '?'), ''),
                           string_split(lpad(runs[k].y, greatest(length(runs[k].x), length(runs[k].y))::INTEGER, '?'), '')),
        lambda c: c[1] <> '?' OR c[2] <> '?'), lambda c: c[{p}]), '')
      || coalesce(nullif({s}[all_links[k][{p}] + 1], '?'), '')), '')"""  # noqa: E731
    return f"""(SELECT * EXCLUDE (a_, b_, best, links, all_links, runs),
    CASE WHEN x = y THEN replace(x, '?', '') ELSE {side('a_', 1)} END AS nx,
    CASE WHEN x = y THEN replace(y, '?', '') ELSE {side('b_', 2)} END AS ny FROM (
  SELECT *, list_transform(range(1, len(links) + 2), lambda k: {{
      'x': array_to_string(a_[coalesce(all_links[k - 1][1] + 2, 1):all_links[k][1]], '') || repeat('?', greatest(all_links[k][2] - all_links[k][1], 0)),
      'y': array_to_string(b_[coalesce(all_links[k - 1][2] + 2, 1):all_links[k][2]], '') || repeat('?', greatest(all_links[k][1] - all_links[k][2], 0))}}) AS runs FROM (
  SELECT *, list_append(links, [length(x)::INTEGER, length(x)::INTEGER]) AS all_links FROM (
  SELECT *, CASE WHEN x = y THEN [[0, 0]][:0] ELSE list_reduce(
    list_transform(range(0, 2 * length(x) + 1), lambda s: {{'i': 0, 'j': 0, 'links': [[0, 0]][:0]}}),
    lambda s, e: CASE WHEN best[s.i + 1][s.j + 1] = 0 THEN s
      WHEN a_[s.i + 1] = b_[s.j + 1] THEN {{'i': s.i + 1, 'j': s.j + 1, 'links': list_append(s.links, [s.i, s.j])}}
      WHEN best[s.i + 2][s.j + 1] = best[s.i + 1][s.j + 1] THEN {{'i': s.i + 1, 'j': s.j, 'links': s.links}}
      ELSE {{'i': s.i, 'j': s.j + 1, 'links': s.links}} END).links END AS links FROM (
  SELECT *, CASE WHEN x = y THEN [[0]] ELSE list_reduce(
    list_prepend([list_transform(range(0, length(x) + 1), lambda j: 0)], list_transform(range(length(x) - 1, -1, -1), lambda i: [[i::INTEGER]])),
    lambda rows, e: list_prepend(list_transform(range(1, length(x) + 2), lambda j: coalesce(list_max(
      list_transform(range(1, length(x) + 1), lambda jj: CASE WHEN jj < j THEN 0
        WHEN a_[e[1][1] + 1] = b_[jj] THEN rows[1][jj + 1] + 1 ELSE rows[1][jj] END)), 0)::INTEGER), rows)) END AS best FROM (
  SELECT *, string_split(x, '') AS a_, string_split(y, '') AS b_ FROM {source}))))))"""


def swept(source: str, keys: list, configs: tuple) -> str:
    """sweeps(keys, cfg, score, ref_aln, hyp_aln); the statement has to be
    recursive. A round of the recursion moves every window of every pair on."""
    k = ", ".join(keys)
    each = " UNION ALL ".join(f"SELECT {c} AS cfg, {w} AS win, {s} AS stride" for c, (w, s) in enumerate(configs))
    step = _window(f"""(SELECT *, substr(xa, 1, win) AS x, substr(xb, 1, win) AS y FROM (
    SELECT *, open_a || substr(a, read + 1, more) AS xa, open_b || substr(b, read + 1, more) AS xb, read + more AS read2 FROM (
    SELECT *, greatest(0, win - length(open_a))::INTEGER AS more FROM moves WHERE start + win < size)))""")
    last = _window("""(SELECT *, open_a || substr(a, read + 1) AS x, open_b || substr(b, read + 1) AS y FROM moves
    WHERE start + win >= size)""")
    return f"""moves AS (
  SELECT {k}, cfg, win, stride, n, rpad(ref, n, '?') AS a, rpad(hyp, n, '?') AS b, '' AS done_a, '' AS done_b, '' AS open_a,
    '' AS open_b, 0 AS read, 0 AS start, n AS size
  FROM (SELECT *, greatest(length(ref), length(hyp))::INTEGER AS n FROM {source}), ({each}) AS configs WHERE n > 0 AND ref <> hyp
  UNION ALL
  SELECT {k}, cfg, win, stride, n, a, b, done_a || substr(oa, 1, stride), done_b || substr(ob, 1, stride),
    substr(oa, stride + 1), substr(ob, stride + 1), read3, start + stride, size2 FROM (
    SELECT *, oa1 || substr(a, read2 + 1, short) AS oa, ob1 || substr(b, read2 + 1, short) AS ob, read2 + short AS read3 FROM (
    SELECT *, greatest(0, stride - length(oa1))::INTEGER AS short FROM (
    SELECT *, nx || substr(xa, win + 1) AS oa1, ny || substr(xb, win + 1) AS ob1, (size + length(nx) - win)::INTEGER AS size2
    FROM {step} AS w) AS o) AS p) AS q),
swept AS (SELECT {k}, cfg, n, done_a || nx AS ref_aln, done_b || ny AS hyp_aln FROM {last} AS w),
sweeps AS (
  SELECT {k}, cfg, len(list_filter(list_zip(string_split(substr(ref_aln, 1, n), ''), string_split(hyp_aln, '')),
    lambda c: c[1] = c[2])) / n AS score, ref_aln, hyp_aln FROM swept
  UNION ALL SELECT {k}, cfg, 1.0, ref, hyp FROM {source}, ({each}) AS configs WHERE ref = hyp AND ref <> '')"""


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- sources ---------------------------------------------------------------
DOC_LINES = LINES.replace("{docs}", "documents")
add("text_lines", f"WITH {DOC_LINES} SELECT doc_id, line_no, line FROM lines")
add("clip_table", f"WITH {CLIPS} SELECT path, split, src_row, length(sentence)::INTEGER AS chars FROM listed")
add("first_line_predictions", "SELECT 'clip_' || doc_id AS path, string_split(text, chr(10))[1] AS predicted FROM documents")
add("vector_sidecars", """SELECT vec_id, len(embedding)::INTEGER AS dims, embedding[1]::DOUBLE AS first,
  embedding[-1]::DOUBLE AS last, list_max(embedding)::DOUBLE AS top FROM embeddings""")
FRAMES = """frames AS (SELECT 'clip_' || label AS path, vec_id AS frame_no,
  list_concat(embedding[1:1], embedding[5:44])::DOUBLE[] AS scores FROM embeddings),
best AS (SELECT *, (list_position(scores, list_max(scores)) - 1)::INTEGER AS best FROM frames)"""
add("logit_columns", f"""WITH {FRAMES} SELECT path, frame_no, len(scores)::INTEGER AS symbols, scores[1] AS blank,
  scores[2] AS first, scores[41] AS last, best FROM best""")

# --- projections and filters ----------------------------------------------
add("purify_text", f"SELECT doc_id, {purify('text')} AS clean FROM documents")
add("min_words_filter", f"SELECT * FROM (SELECT doc_id, {purify('text')} AS clean FROM documents) WHERE len({words('clean')}) > 3")
add("both_long_filter", f"WITH {TURNS} SELECT * FROM turns WHERE length(ref) > 4 AND length(hyp) > 4")
add("token_budget_filter", f"""WITH {TURNS} SELECT conv_id, turn, a::INTEGER AS n_ref, b::INTEGER AS n_hyp
  FROM (SELECT *, len({marked('ref')}) AS a, len({marked('hyp')}) AS b FROM turns) WHERE a < 32 AND b < 32""")


def status(a: str, b: str) -> str:
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN 'empty' WHEN {a} = {b} THEN 'equal'
      WHEN abs(length({a}) - length({b})) / greatest(length({a}), length({b})) >= 0.8::DOUBLE THEN 'too_different' ELSE 'align' END"""


add("pair_guard", f"""WITH {TURNS} SELECT conv_id, turn, {status('ref', 'hyp')} AS forward,
  {status('ref', 'ref')} AS with_itself, {status('ref', "''")} AS with_nothing FROM turns""")
add("audio_paths", """SELECT * FROM (SELECT doc_id, source || '_' || doc_id ||
  CASE WHEN lang IN ('en', 'fr') THEN '.Mp3' ELSE '.ogg' END AS path FROM documents) WHERE lower(path) LIKE '%.mp3'""")
add("clip_paths", f"""WITH {CLIPS} SELECT path, 'clips/' || path AS audio, 'logits/' || path || '.logits' AS logits,
  'array/' || path || '.array' AS vector, 'predictions/' || path || '.txt' AS text FROM clips""")
add("render_pairs", f"""WITH {TURNS} SELECT conv_id, turn, array_to_string({marked('hyp')}, '~') || '|' ||
  array_to_string({marked('ref')}, '~') AS line FROM turns""")

# --- generators ------------------------------------------------------------
add("clean_corpus", f"WITH {SENT} SELECT * FROM sentences")
add("sentence_split", f"WITH {DOC_LINES}, {SPLIT} SELECT doc_id, line_no, sent_no, sentence FROM split")
STRIPPED = r"""regexp_replace({c}, '^["''“‘«(\[]+|["''”’»)\],;:!?]+$', '', 'g')"""
SCORED = r"""tokens AS (
  SELECT {stripped} AS w FROM (SELECT unnest(regexp_split_to_array(line, '[ \t\n\r\f]+')) AS token FROM lines)),
kinds AS (
  SELECT lower(regexp_replace(w, '\.$', '')) AS type, regexp_matches(w, '[^.]\.$')::BIGINT AS period FROM tokens),
counts AS (
  SELECT type, sum(period)::BIGINT AS n_with, sum(1 - period)::BIGINT AS n_without FROM kinds
  WHERE regexp_matches(type, '^\p{L}[\p{L}.]*$') GROUP BY type),
chance AS (SELECT sum(n_with)::DOUBLE / sum(n_with + n_without)::DOUBLE AS p FROM counts),
sized AS (SELECT *, length(replace(type, '.', ''))::DOUBLE AS letters FROM counts, chance WHERE n_with > 0),
scores AS (
  SELECT type, n_with, n_without, 2 * (n_with * (ln(0.99::DOUBLE) - ln(p)) + CASE WHEN n_without > 0
    THEN n_without * (ln(1 - 0.99::DOUBLE) - ln(1 - p)) ELSE 0 END)
    * exp(-letters) * (length(type) - letters + 1) * pow(letters, -n_without::DOUBLE) AS score FROM sized)
""".replace("{stripped}", STRIPPED.replace("{c}", "token"))
add("abbreviation_scores", f"WITH {DOC_LINES}, {SCORED} SELECT type, n_with, n_without, round(score, 6) AS score FROM scores")
add("learned_sentences", rf"""WITH {DOC_LINES}, {SCORED}, cuts AS (
  SELECT doc_id, line_no, string_split(regexp_replace(line, '([.!?]+["''”’»)\]]*)([ \t\n\r\f]+)', '\1\2' || chr(1), 'g'), chr(1)) AS ps
  FROM lines),
pieces AS (
  SELECT * FROM (SELECT doc_id, line_no, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS pos FROM cuts)
  WHERE pos = 0 OR piece <> ''),
ends AS (SELECT *, {STRIPPED.replace("{c}", "regexp_extract(piece, '([^ \t\n\r\f]+)[ \t\n\r\f]*$', 1)")} AS w FROM pieces),
typed AS (
  SELECT *, CASE WHEN regexp_matches(w, '[^.]\.$') THEN lower(regexp_replace(w, '\.$', '')) END AS type,
    coalesce(regexp_matches(lead(piece) OVER (PARTITION BY doc_id, line_no ORDER BY pos), '^\p{{Ll}}'), false) AS small FROM ends),
glue AS (
  SELECT *, coalesce(type IN (SELECT type FROM scores WHERE score >= 0.3), false)
    OR coalesce(regexp_matches(type, '^\p{{L}}$'), false) OR (regexp_matches(w, '\.\.$') AND small) AS glued FROM typed),
before AS (
  SELECT *, coalesce(lag(glued) OVER (PARTITION BY doc_id, line_no ORDER BY pos), false) AS joined FROM glue),
numbered AS (
  SELECT *, (sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, line_no ORDER BY pos) - 1)::INTEGER AS sent_no
  FROM before)
SELECT doc_id, line_no, sent_no, regexp_replace(string_agg(piece, '' ORDER BY pos), '[ \t\n\r\f]+$', '') AS sentence
FROM numbered GROUP BY doc_id, line_no, sent_no""")


def rule_words(c: str) -> str:
    """The fixed word rules, as nested replacements."""
    marked = f"regexp_replace({c}, '[ \t\n\r\f]+', ' ', 'g')"
    for pattern, put in text.WORD_RULES:
        quoted = [x.replace("'", "''") for x in (pattern, re.sub(r"\$(\d)", r"\\\1", put))]
        marked = f"regexp_replace({marked}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return words(marked)


add("rule_word_tokens", f"""WITH {DOC_LINES}, {SPLIT} SELECT doc_id, line_no, sent_no, len(w)::INTEGER AS n,
  array_to_string(w, '|') AS words FROM (SELECT *, {rule_words('sentence')} AS w FROM split)""")
add("word_tokens_of_sentences", f"""WITH {SENT} SELECT doc_id, line_no, sent_no, len({words('sentence')})::INTEGER AS n,
  array_to_string({words('sentence')}, '|') AS words FROM sentences""")
add("word_windows", f"WITH {SENT}, {WINDOWS} SELECT * FROM windows")
add("char_windows", f"""WITH {SENT} SELECT doc_id, line_no, sent_no, unnest(ws) AS "window",
  (generate_subscripts(ws, 1) - 1)::INTEGER AS win_no FROM (SELECT *, CASE WHEN length(sentence) < 100 THEN [sentence]
  ELSE list_transform(range(0, (length(sentence) - 100) // 25 + 2), lambda i: substr(sentence, i * 25 + 1, 100)) END AS ws
  FROM sentences)""")
BALANCED = """parts AS (
  SELECT doc_id, line_no, sent_no, part_no, string_agg(word, ' ' ORDER BY pos) AS part FROM (
    SELECT *, (pos - 1) AS p0, {tile} AS part_no FROM (
      SELECT doc_id, line_no, sent_no, n, len(w) AS l, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM counted))
  GROUP BY ALL)"""
# first l % n parts take one word more
TILE = """(CASE WHEN p0 < (l % n) * (l // n + 1) THEN p0 // (l // n + 1)
  ELSE l % n + (p0 - (l % n) * (l // n + 1)) // (l // n) END)::INTEGER"""


def parts(n: str) -> str:
    return f"""counted AS (SELECT doc_id, line_no, sent_no, w, {n} AS n FROM (
      SELECT *, {words('sentence')} AS w FROM sentences)), {BALANCED.replace('{tile}', TILE.replace('p0', '(pos - 1)'))}"""


add("balanced_split", f"WITH {SENT}, {parts('3')} SELECT * FROM parts")
add("auto_split_words", f"WITH {SENT}, {parts('greatest(ceil(len(w) / 22.0), 1)::BIGINT')} SELECT * FROM parts")
# every count is tried, up to one that surely fits; sums come from running totals
add("auto_split_chars", f"""WITH {SENT}, tok AS (
  SELECT doc_id, line_no, sent_no, {words('sentence')} AS w FROM sentences),
lens AS (SELECT *, len(w) AS l, list_transform(w, lambda x: length(x)) AS t FROM tok),
run AS (SELECT *, list_concat([0], list_transform(range(1, l + 1), lambda i: list_sum(t[1:i])))::BIGINT[] AS s
  FROM lens WHERE list_max(t) <= 22),
tries AS (SELECT doc_id, line_no, sent_no, l, s, unnest(range(
  greatest(ceil((s[l + 1] + l) / 23.0), 1)::BIGINT,
  least(l, ceil(l / greatest(23 // (list_max(t) + 1), 1)))::BIGINT + 1)) AS n FROM run),
fits AS (SELECT *, list_max(list_transform(range(0, n), lambda c:
    s[(c + 1) * (l // n) + least(c + 1, l % n) + 1] - s[c * (l // n) + least(c, l % n) + 1]
    + (l // n) + CASE WHEN c < l % n THEN 1 ELSE 0 END - 1)) AS worst FROM tries),
chosen AS (SELECT doc_id, line_no, sent_no, min(n) AS m FROM fits WHERE worst <= 22 GROUP BY ALL),
counted AS (SELECT doc_id, line_no, sent_no, w, coalesce(m, l) AS n FROM lens LEFT JOIN chosen USING (doc_id, line_no, sent_no)),
{BALANCED.replace('{tile}', TILE.replace('p0', '(pos - 1)'))} SELECT * FROM parts""")
add("aligned_windows", f"""WITH {PADDED}, {wins(3, 3)} SELECT conv_id, turn, count(*) AS windows,
  count(*) FILTER (ref_win = hyp_win) AS same, min(ref_win) AS least_ref, max(hyp_win) AS most_hyp,
  max("at")::INTEGER AS last FROM wins GROUP BY ALL""")
add("char_ngram_arrays", f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN length(ref) < 3 THEN '' ELSE
  array_to_string(list_transform(range(1, length(ref) - 1), lambda i: array_to_string(string_split(ref, '')[i:i + 2], '')), '|')
  END AS grams FROM turns""")
CHUNKS = chunks("sentences", SK, "sentence", 11)
add("random_chunks", f"""WITH {SENT}, {CHUNKS} SELECT doc_id, line_no, sent_no,
  string_agg(chunk, '|' ORDER BY k) AS chunks FROM chunked GROUP BY ALL""")
add("chunk_offsets", f"""WITH {SENT}, {CHUNKS} SELECT doc_id, line_no, sent_no, max(start + length(chunk))::BIGINT AS chars,
  count(*) AS chunks, sum((start + length(chunk)) * (k + 1))::BIGINT AS mix FROM chunked GROUP BY ALL""")

# --- joins and lookups -----------------------------------------------------
add("clip_sentence", f"WITH {CLIPS} SELECT path, split, sentence FROM clips JOIN actual USING (path)")
SIDE = "side AS (SELECT path, bool_or(split = 'test') AS is_test FROM listed GROUP BY ALL)"
add("split_of_clip", f"WITH {CLIPS}, {SIDE} SELECT path, is_test FROM clips LEFT JOIN side USING (path)")
add("split_of_known_clip", f"WITH {CLIPS}, {SIDE} SELECT path, is_test FROM listed JOIN side USING (path)")
add("unknown_clips", f"WITH {CLIPS} SELECT path FROM clips WHERE path NOT IN (SELECT path FROM listed)")
add("evaluation_pairs", f"WITH {CLIPS} SELECT * FROM pairs")
add("repeated_evaluation_pairs", f"""WITH {CLIPS} SELECT * FROM pairs UNION ALL
  SELECT p.* FROM pairs p JOIN test t USING (path) WHERE t.src_row % 3 = 0""")
add("unmatched_clips", f"""WITH {CLIPS} SELECT path, 'predicted' AS only_in FROM heard WHERE path NOT IN (SELECT path FROM train)
  UNION ALL SELECT DISTINCT path, 'actual' FROM train WHERE path NOT IN (SELECT path FROM heard)""")
add("processed_clips", f"WITH {CLIPS} SELECT path, predicted FROM heard WHERE path IN (SELECT key FROM ledger)")
add("pending_clips", f"""WITH {CLIPS} SELECT path FROM clips WHERE lower(path) LIKE '%.mp3'
  AND path NOT IN (SELECT key FROM ledger)""")
add("chunk_candidates", f"""WITH {CONFUSIONS} SELECT chunk, sum(cnt)::BIGINT AS total, count(*)::INTEGER AS n,
  min(replacement) AS first FROM confusions GROUP BY ALL""")
add("ids_with_oov", f"""WITH {TURNS}, vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (
  SELECT DISTINCT unnest({words('t')}) AS token FROM (SELECT {purify('text')} AS t FROM benchmark))),
toks AS (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (
  SELECT conv_id, turn, {words('ref')} AS w FROM turns)),
looked AS (SELECT conv_id, turn, string_agg(coalesce(id, (SELECT count(*) FROM vocab) +
  ('0x' || substr(md5(token), 1, 8))::BIGINT % 5)::VARCHAR, ' ' ORDER BY pos) AS ids
  FROM toks LEFT JOIN vocab USING (token) GROUP BY ALL)
SELECT conv_id, turn, coalesce(ids, '') AS ids FROM turns LEFT JOIN looked USING (conv_id, turn)""")
CHARS = """vocab AS (SELECT * FROM (VALUES ('[START]', 1), ('[END]', 2), ('[PAD]', 3), ('[UNK]', 4)) AS t(token, id)
  UNION ALL SELECT token, (row_number() OVER (ORDER BY token) + 4)::INTEGER FROM (
  SELECT DISTINCT unnest(string_split({c}, '')) AS token FROM {t} WHERE {c} <> ''))"""
TURN_CHARS = CHARS.replace("{c}", "ref").replace("{t}", "turns")
SPELLED = """spelled AS (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (
  SELECT conv_id, turn, string_split(ref, '') AS w FROM turns WHERE ref <> ''))"""
# the start marker is id 1, the end marker id 2; both are known to the reader
add("tokens_from_ids", f"""WITH {TURNS}, {TURN_CHARS}, {SPELLED}, back AS (
  SELECT conv_id, turn, string_agg(token, '' ORDER BY pos) AS t FROM spelled JOIN vocab USING (token)
  WHERE id % 7 <> 0 GROUP BY ALL)
SELECT conv_id, turn, '[START]' || coalesce(t, '') || '[END]' AS text FROM turns LEFT JOIN back USING (conv_id, turn)""")

# --- alignment and confusion learning --------------------------------------
add("pad_pairs", f"WITH {PADDED} SELECT * FROM padded")
add("gaps_restore_inputs", f"""WITH {SENT}, {SEEDS}, {corrupted('sentences', SK, 'sentence', 7)}
  SELECT doc_id, line_no, sent_no, sentence AS ref, corrupted AS hyp, true AS same_length FROM noisy""")
PARTS = f"""parts AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand) AS name FROM part), {SEEDS},
{corrupted('parts', ['p_partkey'], 'name', 7)},
part_pairs AS (SELECT p_partkey, name AS ref, corrupted AS hyp FROM noisy)"""
add("unbanded_part_alignment", f"""WITH {PARTS}, {aligned('part_pairs', ['p_partkey'], None, 'found')}
  SELECT p_partkey, ref, hyp, ref_aln, hyp_aln FROM found""")
SWEEPS = swept("part_pairs", ["p_partkey"], ((3, 2), (6, 2), (7, 3), (8, 3), (9, 5)))
BEST = """best AS (
  SELECT p_partkey, round(score, 6) AS score, CASE WHEN score > 0 THEN cfg::INTEGER END AS cfg,
    CASE WHEN score > 0 THEN ref_aln ELSE ' ' END AS ref_aln, CASE WHEN score > 0 THEN hyp_aln ELSE ' ' END AS hyp_aln
  FROM sweeps QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, cfg) = 1)"""
add("part_sweeps", f"""WITH RECURSIVE {PARTS}, {SWEEPS}
  SELECT p_partkey, cfg::INTEGER AS cfg, round(score, 6) AS score, ref_aln, hyp_aln FROM sweeps""")
add("part_best_alignment", f"WITH RECURSIVE {PARTS}, {SWEEPS}, {BEST} SELECT * FROM best")
add("part_confusions", f"""WITH RECURSIVE {PARTS}, {SWEEPS}, {BEST}, named AS (SELECT *, p_partkey AS conv_id, 0 AS turn FROM best),
{wins(1, 3, 'named')} {forward()}""")
add("part_clip_confusions", f"""WITH RECURSIVE {PARTS}, clip_pairs AS (
  SELECT p_partkey, {purify('ref')} AS ref, {purify('hyp')} AS hyp FROM part_pairs JOIN part USING (p_partkey) WHERE p_size <= 25),
{swept("clip_pairs", ["p_partkey"], ((3, 2), (6, 2), (7, 3), (8, 3), (9, 5)))}, {BEST},
named AS (SELECT *, p_partkey AS conv_id, 0 AS turn FROM best), {wins(1, 3, 'named')} {forward()}""")
GUARDED = """guarded AS (SELECT *, CASE WHEN ref = '' OR hyp = '' THEN 'empty' WHEN ref = hyp THEN 'equal'
    WHEN abs(length(ref) - length(hyp)) * 10 >= greatest(length(ref), length(hyp)) * 8 THEN 'too_different'
    ELSE 'align' END AS status FROM bare)
  SELECT p_partkey, g.ref, g.hyp, status,
    CASE status WHEN 'equal' THEN g.ref WHEN 'align' THEN ref_aln END AS ref_aln,
    CASE status WHEN 'equal' THEN g.hyp WHEN 'align' THEN hyp_aln END AS hyp_aln
  FROM guarded g LEFT JOIN found USING (p_partkey)"""
add("bulk_part_alignment", f"""WITH {PARTS}, bare AS (
  SELECT p_partkey, replace(ref, ' ', '') AS ref, replace(hyp, ' ', '') AS hyp FROM part_pairs),
{aligned('bare', ['p_partkey'], 10, 'found')}, {GUARDED}""")
add("banded_part_alignment", f"""WITH {PARTS}, {aligned('part_pairs', ['p_partkey'], 10, 'found')},
guarded AS (SELECT *, CASE WHEN ref = '' OR hyp = '' THEN 'empty' WHEN ref = hyp THEN 'equal'
    WHEN abs(length(ref) - length(hyp)) * 10 >= greatest(length(ref), length(hyp)) * 8 THEN 'too_different'
    ELSE 'align' END AS status FROM part_pairs)
  SELECT p_partkey, g.ref, g.hyp, status,
    CASE status WHEN 'equal' THEN g.ref WHEN 'align' THEN ref_aln END AS ref_aln,
    CASE status WHEN 'equal' THEN g.hyp WHEN 'align' THEN hyp_aln END AS hyp_aln
  FROM guarded g LEFT JOIN found USING (p_partkey)""")
add("column_pairs", f"""WITH {PADDED} SELECT conv_id, turn, (generate_subscripts(r, 1) - 1)::INTEGER AS col,
  unnest(r) AS ref_ch, unnest(h) AS hyp_ch FROM (
  SELECT conv_id, turn, string_split(ref_aln, '') AS r, string_split(hyp_aln, '') AS h FROM padded WHERE ref_aln <> '')""")
add("forward_confusions", f"WITH {CONFUSIONS} SELECT * FROM confusions")
add("reverse_confusions", f"WITH {PADDED}, {wins(1, 11)} {reverse()}")
add("merged_confusions", f"WITH {PADDED}, {wins(1, 11)} {reverse()}")

# --- noise and suggestions -------------------------------------------------
add("corrupted_corpus", f"""WITH {SENT}, {SEEDS}, {corrupted('sentences', SK, 'sentence', 7)}
  SELECT doc_id, line_no, sent_no, sentence AS ref, corrupted AS hyp FROM noisy""")
add("corrupted_turns", f"""WITH {CONFUSIONS}, {corrupted('turns', ['conv_id', 'turn'], 'ref', 3, 3)}
  SELECT conv_id, turn, ref, corrupted FROM noisy""")
add("noisy_training_pairs", f"""WITH {SENT}, {WINDOWS}, {SEEDS}, {corrupted('windows', [*SK, 'win_no'], '"window"', 5)}
  SELECT doc_id, line_no, sent_no, win_no, array_to_string(a, '~') || '|' || array_to_string(b, '~') AS line
  FROM (SELECT *, {marked('corrupted')} AS a, {marked('"window"')} AS b FROM noisy) WHERE len(a) < 32 AND len(b) < 32""")
add("known_spans", f"""WITH {CONFUSIONS} SELECT * FROM (
  SELECT p_partkey, (a - 1)::INTEGER AS "at", unnest(range(1, least(11, length(p_name) - a + 1)::BIGINT + 1))::INTEGER AS len,
    substr(p_name, a, len) AS chunk
  FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS a FROM part))
  WHERE chunk IN (SELECT chunk FROM confusions)""")
add("weighted_picks", f"""WITH {CONFUSIONS}, {CANDIDATES}, asked AS (
  SELECT *, {row_seed(1, 'chunk')} AS rs FROM (SELECT DISTINCT chunk, total FROM cands),
    (SELECT unnest(range(0, 5))::INTEGER AS k) AS ks),
drawn AS (SELECT * FROM {with_wide_draw('asked', 'rs', 'k')})
SELECT d.chunk, k, repl FROM drawn d JOIN cands c ON c.chunk = d.chunk AND r % d.total >= lo AND r % d.total < hi""")

# --- aggregations and statistics -------------------------------------------
add("word_error_rate", f"""WITH RECURSIVE {TURNS}, {EDITS} SELECT sum(edits)::BIGINT AS edits, sum(ref_words)::BIGINT AS ref_words,
  round(sum(edits)::DOUBLE / sum(ref_words), 9) AS wer FROM edits""")
add("turn_word_edits", f"""WITH RECURSIVE {TURNS}, {EDITS} SELECT conv_id, turn, edits::INTEGER AS edits,
  ref_words::INTEGER AS ref_words FROM edits""")
add("longest_tokenisation", f"""WITH {SENT}, {WINDOWS} SELECT doc_id, max(len({words('"window"')}))::INTEGER AS max_tokens
  FROM windows GROUP BY ALL""")
add("vocabulary_size", f"WITH {TURNS}, {TURN_CHARS} SELECT count(*) AS size FROM vocab")
GRAMS = f"""padded AS (SELECT list_concat(['<s>'], {words('sentence')}, ['</s>']) AS t FROM sentences),
places AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM padded),
grams AS (SELECT o AS "order", array_to_string(t[i:i + o - 1], ' ') AS ngram FROM places,
  (SELECT unnest([1, 2, 3])::INTEGER AS o) AS os WHERE i + o - 1 <= len(t)),
counts AS (SELECT "order", ngram, count(*) AS cnt FROM grams GROUP BY ALL)"""
add("ngram_counts", f"WITH {SENT}, {GRAMS} SELECT * FROM counts")
# words are split into columns; discounts stay double
add("language_model", f"""WITH {SENT}, {GRAMS},
c AS MATERIALIZED (SELECT "order" AS o, ngram, cnt, string_split(ngram, ' ') AS w FROM counts),
adj AS MATERIALIZED (
  SELECT 3 AS o, w[1] AS w1, w[2] AS w2, w[3] AS w3, cnt AS a FROM c WHERE o = 3
  UNION ALL SELECT 2, w[1], w[2], NULL, cnt FROM c WHERE o = 2 AND w[1] = '<s>'
  UNION ALL SELECT 2, w[2], w[3], NULL, count(*) FROM c WHERE o = 3 GROUP BY ALL
  UNION ALL SELECT 1, w[2], NULL, NULL, count(*) FROM c WHERE o = 2 GROUP BY ALL),
t AS (SELECT o, count(*) FILTER (a = 1) AS t1, count(*) FILTER (a = 2) AS t2, count(*) FILTER (a = 3) AS t3,
  count(*) FILTER (a = 4) AS t4, sum(a) AS total, count(*) AS types FROM adj GROUP BY ALL),
y AS (SELECT *, t1::DOUBLE / (t1::DOUBLE + 2 * t2::DOUBLE) AS y FROM t),
d AS MATERIALIZED (SELECT o, total, types, 1 - 2 * y * t2::DOUBLE / t1::DOUBLE AS d1, 2 - 3 * y * t3::DOUBLE / t2::DOUBLE AS d2,
  3 - 4 * y * t4::DOUBLE / t3::DOUBLE AS d3 FROM y),
u AS MATERIALIZED (SELECT adj.*, (CASE WHEN a = 1 THEN d1 WHEN a = 2 THEN d2 ELSE d3 END) AS disc FROM adj JOIN d USING (o)),
b0 AS (SELECT sum(disc) / sum(a)::DOUBLE AS b, count(*) + 1 AS v, sum(a)::DOUBLE AS total FROM u WHERE o = 1),
x2 AS MATERIALIZED (SELECT w1, sum(a)::DOUBLE AS s, sum(disc) / sum(a)::DOUBLE AS g FROM u WHERE o = 2 GROUP BY ALL),
x3 AS MATERIALIZED (SELECT w1, w2, sum(a)::DOUBLE AS s, sum(disc) / sum(a)::DOUBLE AS g FROM u WHERE o = 3 GROUP BY ALL),
p1 AS MATERIALIZED (SELECT w1, (a - disc) / total + b / v AS p FROM u, b0 WHERE o = 1),
p2 AS MATERIALIZED (SELECT u.w1, u.w2, (a - disc) / s + g * p AS p FROM u JOIN x2 ON x2.w1 = u.w1 JOIN p1 ON p1.w1 = u.w2 WHERE o = 2),
p3 AS (SELECT u.w1, u.w2, u.w3, (a - disc) / s + g * p AS p FROM u JOIN x3 ON x3.w1 = u.w1 AND x3.w2 = u.w2
  JOIN p2 ON p2.w1 = u.w2 AND p2.w2 = u.w3 WHERE o = 3),
m AS (
  SELECT 1 AS o, q.w1 AS ngram, p, g FROM (SELECT * FROM p1 UNION ALL SELECT '<unk>', b / v FROM b0 UNION ALL SELECT '<s>', NULL) q
    LEFT JOIN x2 ON x2.w1 = q.w1
  UNION ALL SELECT 2, p2.w1 || ' ' || p2.w2, p, g FROM p2 LEFT JOIN x3 ON x3.w1 = p2.w1 AND x3.w2 = p2.w2
  UNION ALL SELECT 3, w1 || ' ' || w2 || ' ' || w3, p, NULL FROM p3)
SELECT o::INTEGER AS "order", ngram, round(log10(p), 6) AS logp,
  CASE WHEN o < 3 THEN round(coalesce(log10(g), 0), 6) END AS log_backoff FROM m""")
BPE_WORDS = """bpe_words AS (SELECT word, count(*) AS cnt FROM (
  SELECT unnest(regexp_extract_all(sentence, '[^ '']+|''+')) AS word FROM sentences) GROUP BY ALL)"""
add("bpe_word_counts", f"WITH {SENT}, {BPE_WORDS} SELECT * FROM bpe_words")
add("bpe_first_pairs", f"""WITH {SENT}, {BPE_WORDS}, spelled AS (
  SELECT cnt, list_concat(string_split(word, '')[:-2], [string_split(word, '')[-1] || '_']) AS s FROM bpe_words)
SELECT s[i] AS "left", s[i + 1] AS "right", sum(cnt)::BIGINT AS cnt
FROM (SELECT *, unnest(range(1, len(s))) AS i FROM spelled) GROUP BY ALL""")
add("char_vocabulary", f"WITH {TURNS}, {TURN_CHARS} SELECT * FROM vocab")

# --- token operators -------------------------------------------------------
add("bpe_round_trip", f"""WITH {SENT} SELECT doc_id, line_no, sent_no,
  array_to_string(regexp_extract_all(sentence, '[^ '']+|''+'), ' ') AS text FROM sentences""")
add("char_token_strings", f"""WITH {TURNS} SELECT conv_id, turn, array_to_string(list_concat(['[START]'],
  CASE WHEN ref = '' THEN [] ELSE string_split(ref, '') END, ['[END]']), ' ') AS tokens FROM turns""")
add("char_token_ids", f"""WITH {TURNS}, b AS (SELECT lower(text) AS x FROM benchmark),
{CHARS.replace('{c}', 'x').replace('{t}', 'b')}, {SPELLED}, looked AS (
  SELECT conv_id, turn, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids FROM spelled JOIN vocab USING (token) GROUP BY ALL)
SELECT conv_id, turn, '1 ' || coalesce(ids || ' ', '') || '2' AS ids FROM turns LEFT JOIN looked USING (conv_id, turn)""")
add("ctc_decode", f"""WITH {FRAMES}, steps AS (
  SELECT *, lag(best) OVER (PARTITION BY path ORDER BY frame_no) AS prev FROM best)
SELECT path, coalesce(string_agg(substr(' ''-abcdefghijklmnopqrstuvwxyzàáèéìíòóùúš', best, 1), '' ORDER BY frame_no)
  FILTER (best <> 0 AND (prev IS NULL OR prev <> best)), '') AS predicted FROM steps GROUP BY ALL""")

# --- limits, unions, listings ----------------------------------------------
add("head_lines", f"WITH {DOC_LINES} SELECT doc_id, line_no, line FROM lines ORDER BY doc_id, line_no LIMIT 1000")
add("head_lines_default", f"WITH {DOC_LINES} SELECT doc_id, line_no, line FROM lines ORDER BY doc_id, line_no LIMIT 400000")
add("union_corpora", f"""SELECT * FROM (WITH {SENT} SELECT * FROM sentences) UNION ALL
  SELECT * FROM (WITH {sentences('(SELECT item_id AS doc_id, text FROM benchmark)')} SELECT * FROM sentences)""")
add("split_listings", f"""WITH {CLIPS} SELECT path, sentence, 'train' AS list FROM train t JOIN actual a USING (path)
  UNION ALL SELECT path, a.sentence, 'test' FROM test t JOIN actual a USING (path)
  UNION ALL SELECT path, {purify('sentence')}, 'train as listed' FROM train
  UNION ALL SELECT path, predicted, 'heard' FROM test JOIN heard USING (path)""".replace(
    "SELECT path, sentence, 'train' AS list FROM train t", "SELECT path, a.sentence, 'train' AS list FROM train t"))
add("validation_pairs", f"""WITH {CLIPS}, {TURNS}, everything AS (
  SELECT * FROM pairs UNION ALL SELECT 'turn-' || conv_id || '-' || turn, ref, hyp FROM turns)
SELECT path, array_to_string(a, '~') || '|' || array_to_string(b, '~') AS line
FROM (SELECT path, {marked('hyp')} AS a, {marked('ref')} AS b FROM everything) WHERE len(a) < 32 AND len(b) < 32""")
