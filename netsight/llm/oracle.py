"""The operators that SQL can express, in SQL for another engine."""

from __future__ import annotations

BLANKS = "[\\x20\\x09-\\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

CONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
items AS (SELECT row_number() OVER () AS k, item_id, {TERMS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i : i + least(10, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
starts AS (
  SELECT r, i, n, w[i : i + n - 1] AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
),
hits AS (SELECT r, i, n, item_id FROM starts JOIN windows USING (win)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT cast(item_id AS varchar))), ',') AS ids
  FROM hits GROUP BY r
),
item_words AS (
  SELECT k, len(w) AS n, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS t FROM items WHERE len(w) >= 10
),
doc_words AS (SELECT r, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS t FROM docs),
shifted AS (
  SELECT k, n, r, j, q - j - e AS shift, min(abs(e) * 2 + (e > 0)::int) AS off
  FROM item_words JOIN doc_words USING (t), (SELECT unnest(range(-2, 3)) AS e) GROUP BY ALL
),
dense AS (SELECT * FROM shifted SEMI JOIN (SELECT k, r, shift FROM shifted GROUP BY ALL HAVING count(*) >= 8) USING (k, r, shift)),
near_windows AS (
  SELECT k, r, shift, a FROM (SELECT *, unnest(range(greatest(1, j - 9), least(j, n - 9) + 1)) AS a FROM dense)
  GROUP BY ALL HAVING count(*) >= 8
),
near_words AS (
  SELECT DISTINCT d.r, d.k, d.shift + d.j + [0, -1, 1, -2, 2][list_position([0, 2, 3, 4, 5], d.off)] AS q
  FROM dense d JOIN near_windows w ON d.k = w.k AND d.r = w.r AND d.shift = w.shift AND d.j BETWEEN w.a AND w.a + 9
),
near_all AS (
  SELECT r, q, item_id FROM near_words JOIN items USING (k)
  UNION ALL SELECT r, unnest(range(i, i + n)), item_id FROM hits
),
near AS (SELECT r, count(DISTINCT q) AS n_near, count(DISTINCT item_id) AS n_near_items FROM near_all GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near, coalesce(n_near_items, 0) AS n_near_items
FROM docs LEFT JOIN places USING (r) LEFT JOIN named USING (r) LEFT JOIN near USING (r)
"""

LINE_DEDUP = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT r, doc_id, place, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS place, unnest(l) AS line FROM docs)
),
numbered AS (
  SELECT r, doc_id, place, array_to_string(w, ' ') AS line, row_number() OVER d AS i,
    sum(len(w)) OVER d AS upto, sum(len(w)) OVER d - len(w) AS before
  FROM lines WHERE len(w) > 0 WINDOW d AS (PARTITION BY r ORDER BY place)
),
forward AS (
  SELECT a.r, a.i AS first, min(b.i) AS last FROM numbered a JOIN numbered b ON a.r = b.r AND b.i >= a.i AND b.upto - a.before >= 50
  GROUP BY a.r, a.i
),
backward AS (
  SELECT b.r, max(a.i) AS first, b.i AS last FROM numbered a JOIN numbered b ON a.r = b.r AND b.i >= a.i AND b.upto - a.before >= 50
  GROUP BY b.r, b.i
),
passages AS (SELECT * FROM forward UNION SELECT * FROM backward),
named AS (
  SELECT p.r, n.doc_id, p.first, min(n.place) AS from_line, max(n.place) AS to_line, string_agg(n.line, chr(10) ORDER BY n.i) AS body
  FROM passages p JOIN numbered n ON p.r = n.r AND n.i BETWEEN p.first AND p.last GROUP BY p.r, n.doc_id, p.first, p.last
),
ordered AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, r, first) AS turn FROM named),
gone AS (SELECT DISTINCT r, unnest(range(from_line, to_line + 1)) AS place FROM ordered WHERE turn > 1),
kept AS (
  SELECT lines.r, string_agg(line, chr(10) ORDER BY place) AS text FROM lines ANTI JOIN gone USING (r, place) GROUP BY lines.r
),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT docs.doc_id, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  coalesce(counts.n, 0) AS n_removed
FROM docs LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
"""

SOURCE_MIX = f"""
WITH sized AS (
  SELECT doc_id, source, cast(len({WORDS}) AS bigint) AS size,
    (cast(('0x' || substr(md5('42:' || coalesce(cast(doc_id AS varchar), '') || ':' || md5(coalesce(text, ''))), 1, 13)) AS bigint) + 0.5::double)
      / 4503599627370496::double AS u,
    length(translate(coalesce(text, ''), '#*$%&|<>!ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))::double
      / greatest(length(coalesce(text, '')), 1) AS share
  FROM documents
),
sources AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 3 AS cap, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight,
    sum(source_size) OVER () AS total
  FROM sources
),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap::double / weight, source IS NULL, encode(source))
),
capped AS (SELECT *, cap <= level * weight AS at_cap FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN at_cap THEN cap::double
    ELSE weight * (SELECT max(level) FROM capped WHERE NOT at_cap) END AS target
  FROM capped
),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS bigint) ELSE 0 END AS epochs FROM targets
),
ordered AS (
  SELECT s.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(u) / greatest(0.1, share * share), s.doc_id IS NULL, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS seen
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  cast(size * (epochs + CASE WHEN seen < budget AND seen + size / 2.0::double <= budget THEN 1 ELSE 0 END) AS bigint) AS taken
FROM ordered
"""

WEB_ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS origin FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, cast(n AS bigint) AS payload_bytes, h AS payload_digest,
  CASE WHEN origin IS NOT NULL AND page_id IS DISTINCT FROM origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN origin IS NOT NULL AND page_id IS DISTINCT FROM origin THEN origin END AS refers_to,
  CASE WHEN origin IS NOT NULL AND page_id IS DISTINCT FROM origin THEN NULL ELSE true END AS intact
FROM p LEFT JOIN first USING (h)
"""

_BYTES = "list_transform(range(1, length(id) + 1), lambda k: [ord(substr(id, k, 1)), -1, -1, -1, -1, -1, -1, -1, -1])"
_CRC32 = (
    f"xor(list_reduce(list_concat([4294967295], flatten({_BYTES})), lambda crc, x: "
    "CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295)"
)


def _edit(cost: str, letter: str, turn: str, rest: str) -> str:
    said = f"CASE WHEN {rest}.said = '' THEN {turn} ELSE {turn} || chr(10) || {rest}.said END" if turn else f"{rest}.said"
    return f"{{'cost': {cost} + {rest}.cost, 'audit': '{letter}' || {rest}.audit, 'said': {said}}}"


def _cheapest(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _if(condition: str, edit: str) -> str:
    return f"CASE WHEN {condition} THEN {edit} END"


#: n, s, u, a: the cheapest repair of a turn and all after it if nothing, system, user, assistant came before.
_WORSE = "(CASE WHEN truncated THEN 3 ELSE 0 END)"
_STAY = "NOT blank AND NOT again"
_AS_IS, _USER, _ASSISTANT = "(role || ':' || text)", "('user:' || text)", "('assistant:' || text)"
_KEPT = {  # initial of the role and what holds after it, by what came before
    "n": (("s", "s"), ("u", "u")), "s": (("u", "u"),), "u": (("a", "a"),), "a": (("u", "u"),),
}
_PLAIN = ", ".join(
    _cheapest(
        _edit("4", "D", "", f"f.{b}"),
        *(_if(f"{_STAY} AND left(role, 1) = '{i}'", _edit(_WORSE, "K", _AS_IS, f"f.{to}")) for i, to in _KEPT[b]),
        _if(_STAY, _edit(f"3 + {_WORSE}", "R", _ASSISTANT if b == "u" else _USER, "f.a" if b == "u" else "f.u")),
    )
    + f" AS {b}"
    for b in "nsua"
)
CONVERSATION_REPAIR = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS id
  FROM conversations
),
faulty AS (SELECT *, {_CRC32} % 20 AS fault FROM turns),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty WHERE fault <> 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM damaged
),
judged AS (
  SELECT *, core = '' AS blank, right(core, 1) NOT IN ('.', '!', '?') AS open_,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM numbered
),
rows_ AS (SELECT *, open_ AND NOT blank AND NOT again AS truncated FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id
),
f AS (
  SELECT conv_id, n + 1 AS i, {{'cost': 0, 'audit': '', 'said': ''}} AS n,
    {{'cost': 6, 'audit': 'II', 'said': 'user:' || chr(10) || 'assistant:'}} AS s, {{'cost': 3, 'audit': 'I', 'said': 'assistant:'}} AS u,
    {{'cost': 0, 'audit': '', 'said': ''}} AS a
  FROM (SELECT DISTINCT conv_id, n FROM rows_)
  UNION ALL
  SELECT conv_id, i, {_cheapest("n", _edit("3", "I", "'user:'", "u"))} AS n, {_cheapest("s", _edit("3", "I", "'user:'", "u"))} AS s, u, a
  FROM (
    SELECT conv_id, i, n, s, {_cheapest("u", _edit("3", "I", "'assistant:'", "a"))} AS u,
      {_cheapest("a", _edit("3", "I", "'user:'", "u"))} AS a
    FROM (SELECT r.conv_id, r.i, {_PLAIN} FROM f JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i - 1)
  )
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate,
  coalesce(k.truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cast(coalesce(f.n.cost, 0) AS bigint) AS cost,
  coalesce(f.n.audit, '') AS audit, sha256(coalesce(f.n.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = 1
"""

_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

HARD_NEGATIVES = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS q
  FROM embeddings WHERE label IS NOT NULL AND {_SOUND}
),
scores AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, cast(list_inner_product(a.q, b.q) AS bigint) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
),
positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
),
negatives AS (
  SELECT p.anchor, p.other AS positive, n.other AS negative, p.score AS ps, n.score AS ns,
    row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS rank
  FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor AS anchor_id, positive AS positive_id, cast(rank AS int) AS rank, negative AS negative_id,
  ps AS positive_score, ns AS negative_score
FROM negatives WHERE rank <= 5
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, cast(embedding AS double[]) AS e FROM embeddings),
sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND r IN (
    SELECT r FROM (SELECT r, e AS embedding FROM v) WHERE {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
),
links AS (
  SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a),
least AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN counts USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_contamination": CONTAMINATION,
        "op7_line_dedup": LINE_DEDUP,
        "op8_source_mix": SOURCE_MIX,
        "op9_web_archives": WEB_ARCHIVES,
        "op11_conversation_repair": CONVERSATION_REPAIR,
        "op12_hard_negatives": HARD_NEGATIVES,
        "op13_near_vectors": NEAR_VECTORS,
    }
