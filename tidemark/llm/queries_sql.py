"""DuckDB SQL of the queries that SQL can express over whole tables. The others are held against brute force in tests."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _nearest(parts: str, books: str) -> str:
    """Entry of each part row (r, p, v) among (p, e, c), ties to the lower index, and its squared distance."""
    return f"""SELECT r, {parts}.p p, any_value(v) v, arg_min(e, [d, e]) e, min(d) d FROM (SELECT r, {parts}.p, v, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT d FROM {parts} JOIN {books} ON {parts}.p = {books}.p) {parts} GROUP BY r, {parts}.p"""


def _means(assigned: str, books: str) -> str:
    """Each entry's componentwise floor of the mean of its parts; unused entries stay."""
    return f"""SELECT {books}.p p, {books}.e e, coalesce(m.c, {books}.c) c FROM {books} LEFT JOIN (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY j) c FROM (SELECT p, e, j, sum(v[j])::DOUBLE s, count(*) n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) j FROM {assigned}) GROUP BY p, e, j) GROUP BY p, e) m ON m.p = {books}.p AND m.e = {books}.e"""


_FAILS = ["len(w) < 50", "100 * len(list_distinct(w)) < 65 * len(w)", "100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t)", "regexp_matches(t, '[#$%&*|]')", "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)"]
_FIRST = ", ".join(f"CASE WHEN x[ascii(substr(o, {k}, 1)) - 64] THEN {k} ELSE 6 END" for k in range(1, 6))

ORACLE = {
    "op6_warc_dictionary": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages), h AS (SELECT page_id, octet_length(b) n, upper(sha1(b)) x, max(page_id) OVER (PARTITION BY sha1(b)) top FROM p)
SELECT page_id, CAST(n AS BIGINT) payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (((instr('0123456789ABCDEF', substr(x, 1 + 5 * i // 4, 1)) - 1) * 16 + greatest(0, instr('0123456789ABCDEF', coalesce(nullif(substr(x, 2 + 5 * i // 4, 1), ''), '0')) - 1)) >> (3 - 5 * i % 4)) % 32, 1) for i in range(32)], '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> top THEN top END refers_to FROM h""",
    "op7_suffix_automaton": f"""WITH it AS (SELECT item_id, {_PLAIN} w FROM benchmark), iw AS (SELECT item_id, least(10, len(w)) s, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) i FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, s, array_to_string(w[i:i + s - 1], ' ') g FROM iw), d AS (SELECT doc_id, {_PLAIN} w FROM documents), sizes AS (SELECT DISTINCT s FROM win),
dw AS (SELECT doc_id, s, w, unnest(range(1, len(w) - s + 2)) i FROM d, sizes WHERE len(w) >= s), m AS (SELECT doc_id, dw.s, i, item_id FROM (SELECT doc_id, s, i, array_to_string(w[i:i + s - 1], ' ') g FROM dw) dw JOIN win ON win.s = dw.s AND win.g = dw.g),
hit AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + s)) p FROM m) GROUP BY 1), it2 AS (SELECT doc_id, count(*) n, string_agg(k, ',' ORDER BY k) l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) k FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(hit.n, 0) n_hit, coalesce(it2.n, 0) n_items, sha256(coalesce(l, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it2 ON d.doc_id = it2.doc_id""",
    "op9_fingerprint_log": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents), g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) p FROM r), words AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p FROM d),
k AS (SELECT doc_id, count(gone.p) n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) kept FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op11_delta_lloyd": f"""WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pt AS (SELECT r, p, q[p * (len(q) // 16) + 1:(p + 1) * (len(q) // 16)] v FROM (SELECT r, q, unnest(range(16)) p FROM k)), c0 AS (SELECT p, r - 1 e, v c FROM pt WHERE r <= 64),
a1 AS ({_nearest("pt", "c0")}), c1 AS ({_means("a1", "c0")}), a2 AS ({_nearest("pt", "c1")}), c2 AS ({_means("a2", "c1")}), a3 AS ({_nearest("pt", "c2")}),
h AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) h FROM (SELECT p, e, array_to_string(c, ',') x FROM c2)), o AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) code, sum(d)::BIGINT error FROM a3 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT label_error, h codebooks_sha256 FROM k JOIN o USING (r), h""",
    "op12_tensored_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY 1), p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)), r AS (SELECT doc_id x, doc_id y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), t AS (SELECT x, min(y) y FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) n_shingles, coalesce(y, d.doc_id) component_id, coalesce(y, d.doc_id) = d.doc_id kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON x = d.doc_id""",
    "op13_filter_replay": f"""WITH d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {_WORDS}) w FROM documents), l AS (SELECT doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic FROM labels GROUP BY 1),
f AS (SELECT doc_id, part, [{", ".join(_FAILS)}] x FROM d), s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) s), o AS (SELECT a.s || b.s || c.s || d.s || e.s o FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.s, b.s, c.s, d.s, e.s])) = 5),
m AS (SELECT part, o filter_order, x, coalesce(good, false) good, coalesce(toxic, false) toxic, least({_FIRST}) f, unnest(range(1, 6)) step FROM f LEFT JOIN l USING (doc_id), o), k AS (SELECT *, x[ascii(substr(filter_order, step, 1)) - 64] fails FROM m),
c AS (SELECT part, filter_order, step::INT step, count(*) FILTER (step < f) kept, count(*) FILTER (step = f) removed, count(*) FILTER (fails AND f < step) redundant, count(*) FILTER (fails AND len(list_filter(x, lambda y: y)) = 1) unique_fails,
  count(*) FILTER (step = f AND good) good_lost, count(*) FILTER (step = f AND toxic) toxic_lost FROM k GROUP BY 1, 2, 3)
SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT shapley FROM c""",
}
