"""DuckDB SQL for the queries of this subpackage that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
SPACE_WORD, ITEM_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _words(table: str, key: str, pattern: str, lower: bool) -> str:
    """(key, n, w, i) rows: every word w of a table's texts, its place i from 1 and their number n."""
    text = _lowered("coalesce(text,'')") if lower else "coalesce(text,'')"
    return f"SELECT {key}, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws)+1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ws FROM {table})"


_ROWS = "d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)"

#: Kind, pattern, counted group and its least length, as the contract and the added rules state them.
_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("repo", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)

_OP1 = f"""WITH {_ROWS},
b AS (SELECT rid, doc_id, encode(coalesce(text,'')) AS b, octet_length(encode(coalesce(text,''))) AS n FROM d),
p AS (SELECT rid, s, md5(b[s:s+199]) AS h FROM (SELECT rid, b, unnest(range(1, n-198)) AS s FROM b WHERE n>=200)),
g AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY h) AS c FROM p) WHERE c>1),
e AS (SELECT rid, s, max(s+199) OVER (PARTITION BY rid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
f AS (SELECT rid, s, sum(CASE WHEN reach IS NULL OR s>reach+1 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s) AS run FROM e),
r AS (SELECT rid, run, min(s) AS s, max(s)+199 AS e FROM f GROUP BY 1,2),
k AS (SELECT r.rid, r.s, r.e, coalesce(lag(r.e) OVER (PARTITION BY r.rid ORDER BY r.s),0) AS before, lead(r.s) OVER (PARTITION BY r.rid ORDER BY r.s) IS NULL AS is_last FROM r),
t AS (SELECT k.rid, sum(k.e-k.s+1) AS n_removed, count(*) AS n_spans, string_agg(hex(b.b[k.before+1:k.s-1]) || CASE WHEN is_last THEN hex(b.b[k.e+1:b.n]) ELSE '' END, '' ORDER BY k.s) AS kept FROM k JOIN b USING (rid) GROUP BY 1)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(t.n_removed,0) AS BIGINT) AS n_removed, CAST(coalesce(t.n_spans,0) AS BIGINT) AS n_spans, sha256(CASE WHEN t.rid IS NULL THEN b.b ELSE unhex(t.kept) END) AS kept_sha256 FROM b LEFT JOIN t USING (rid)"""

_OP3 = f"""WITH {_ROWS},
m AS ({" UNION ALL ".join(f"SELECT rid, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(coalesce(text,''), '{p}', 0) AS w, regexp_extract_all(coalesce(text,''), '{p}', {g}) AS c, regexp_split_to_array(coalesce(text,''), '{p}') AS g FROM d" for k, (kind, p, g, least) in enumerate(_KINDS))}),
u AS (SELECT rid, k, kind, least, unnest(w) AS w, unnest(c) AS c, unnest(g[1:len(w)]) AS g, unnest(range(len(w))) AS i FROM m),
o AS (SELECT rid, k, kind, least, length(w) AS n, length(c) AS c, CAST(sum(length(g)+length(w)) OVER (PARTITION BY rid, k ORDER BY i) AS BIGINT) AS e FROM u),
s AS (SELECT rid, k, e-n AS pos, kind||':'||(e-n)||':'||e AS span FROM o WHERE c>=least),
a AS (SELECT rid, count(*) FILTER (WHERE k=0) AS n_assign, count(*) FILTER (WHERE k=1) AS n_access, count(*) FILTER (WHERE k=2) AS n_hex, string_agg(span, ',' ORDER BY pos, k) FILTER (WHERE k<3) AS base, string_agg(span, ',' ORDER BY pos, k) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign,0) AS n_assign, coalesce(n_access,0) AS n_access, coalesce(n_hex,0) AS n_hex, sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans FROM d LEFT JOIN a USING (rid)"""

_OP4 = f"""WITH {_ROWS},
w AS ({_words("d", "rid, doc_id", SPACE_WORD, False)}),
x AS (SELECT rid, doc_id, i, n, md5(string_agg(w, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM w),
f AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM x WHERE i+49<=n) WHERE least<doc_id),
c AS (SELECT w.rid, w.i, w.w, max(f.i) OVER (PARTITION BY w.rid ORDER BY w.i) AS pos FROM w LEFT JOIN f ON f.rid=w.rid AND f.i=w.i),
t AS (SELECT rid, count(*) AS n_words, count(*) FILTER (WHERE pos IS NOT NULL AND i<pos+50) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE pos IS NULL OR i>=pos+50) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n_words,0) AS n_words, coalesce(n_removed,0) AS n_removed, sha256(coalesce(kept,'')) AS kept_sha256 FROM d LEFT JOIN t USING (rid)"""

_OP7 = f"""WITH {_ROWS},
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT rid, doc_id, string_split(coalesce(text,''), chr(10)) AS ls FROM d)),
k AS (SELECT *, {_lowered(f"trim(line, {BLANKS})")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key)>=20 GROUP BY key HAVING count(DISTINCT doc_id)>=3),
j AS (SELECT k.*, coalesce(k.doc_id<>r.holder, false) AS gone FROM k LEFT JOIN r ON k.key=r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone),'')) AS kept_sha256 FROM j GROUP BY rid, doc_id"""

_OP9 = f"""WITH RECURSIVE {_ROWS},
w AS ({_words("d", "rid, doc_id", SPACE_WORD, True)}),
s AS (SELECT DISTINCT rid, doc_id, h FROM (SELECT rid, doc_id, i, n, md5(string_agg(w, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS h FROM w) WHERE i+3<=n OR i=1),
z AS (SELECT rid, doc_id, count(*) AS n FROM s GROUP BY 1,2),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.h=b.h AND a.rid<b.rid GROUP BY 1,2),
e AS (SELECT p.a, p.b FROM p JOIN z x ON x.rid=p.a JOIN z y ON y.rid=p.b WHERE 100*p.c>=80*(x.n+y.n-p.c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
q(rid, id) AS (SELECT rid, doc_id FROM z UNION SELECT g.b, q.id FROM q JOIN g ON g.a=q.rid JOIN z ON z.rid=g.b WHERE q.id<z.doc_id),
m AS (SELECT rid, min(id) AS id FROM q GROUP BY 1)
SELECT d.doc_id, coalesce(z.n,0) AS n_shingles, coalesce(m.id,d.doc_id) AS component_id, coalesce(m.id,d.doc_id)=d.doc_id AS kept FROM d LEFT JOIN z USING (rid) LEFT JOIN m USING (rid)"""

_OP10 = f"""WITH {_ROWS},
w AS ({_words("d", "rid", ITEM_WORD, True)}),
bm AS (SELECT row_number() OVER () AS bid, item_id, text FROM benchmark),
v AS ({_words("bm", "bid, item_id", ITEM_WORD, True)}),
iw AS (SELECT DISTINCT item_id, least(n,10) AS size, win FROM (SELECT item_id, i, n, string_agg(w, ' ') OVER (PARTITION BY bid ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS win FROM v) WHERE i+9<=n OR i=1),
dw AS ({" UNION ALL ".join(f"SELECT rid, i, {n} AS size, win FROM (SELECT rid, i, n, string_agg(w, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS win FROM w WHERE {n} IN (SELECT size FROM iw)) WHERE i+{n - 1}<=n" for n in range(1, 11))}),
h AS (SELECT DISTINCT rid, i, dw.size, item_id FROM dw JOIN iw ON dw.win=iw.win AND dw.size=iw.size),
c AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i+size)) AS i FROM (SELECT DISTINCT rid, i, size FROM h)) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY 1),
n AS (SELECT rid, count(*) AS n_words FROM w GROUP BY 1)
SELECT d.doc_id, coalesce(n.n_words,0) AS n_words, coalesce(c.n_hit,0) AS n_hit, coalesce(t.n_items,0) AS n_items, sha256(coalesce(t.items,'')) AS items_sha256, coalesce(c.n_hit,0)>0 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""

_OP11 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0,'user'),(1,'assistant')) v(t, r)),
e AS (SELECT *, 4+length(regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g'))+2+length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g'))+8 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role='assistant'),0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role='assistant'),'')) AS loss_sha256,
CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

_OP12 = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang,'') AS lang, coalesce(source,'') AS source, coalesce(text,'') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all({_lowered("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid)>=3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT c.lang, c.source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n,0) AS n, CAST(1+(CAST(1000000000 AS HUGEINT)*(coalesce(c.n,0)+1))//(coalesce(t.n,0)+v.v) AS BIGINT) AS p, CAST(1+(CAST(1000000000 AS HUGEINT)*(k.n+1))//(v.n+v.v) AS BIGINT) AS q
FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang=g.lang AND t.source=g.source LEFT JOIN c ON c.lang=g.lang AND c.source=g.source AND c.term=k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p-b.p)*(a.p-b.p)//b.p) AS value FROM p a JOIN p b ON a.lang=b.lang AND a.term=b.term AND a.source<>b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value,0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang=b.lang AND a.source<>b.source LEFT JOIN s ON s.lang=a.lang AND s.source=a.source AND s.item=b.source
UNION ALL SELECT lang, source, 'term', term, (p-q)*(p-q)//q FROM p WHERE n>0 AND p>q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part='pair' OR rank<=200"""

_OP13 = """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id%7=0 THEN (label+1)%10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256*CAST(x AS DOUBLE)) AS BIGINT)) AS e
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
x AS (SELECT vec_id, label, unnest(e) AS x, unnest(range(len(e))) AS i FROM v),
s AS (SELECT a.vec_id AS anchor_id, a.label=b.label AS alike, b.vec_id AS id, CAST(sum(a.x*b.x) AS BIGINT) AS score FROM x a JOIN x b ON a.i=b.i AND a.vec_id<>b.vec_id WHERE a.vec_id%100=0 GROUP BY a.vec_id, a.label=b.label, b.vec_id),
p AS (SELECT anchor_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE alike) WHERE r<=5),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
FROM p JOIN s ON s.anchor_id=p.anchor_id AND NOT s.alike AND 30*p.score<=100*s.score AND 100*s.score<=90*p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank<=10"""

SQL: dict[str, str] = {"op1_suffix_dedup": _OP1, "op3_secret_scans": _OP3, "op4_substring_dedup": _OP4, "op7_line_dedup": _OP7, "op9_near_dedup": _OP9, "op10_decontamination": _OP10, "op11_chat_formatting": _OP11, "op12_source_divergence": _OP12, "op13_hard_negatives": _OP13}
