"""SQL of another engine (DuckDB) for the queries of this subpackage that it can express."""

from __future__ import annotations

from sedge.llm.embedding_dedup import COSINE
from sedge.llm.secret_scan import ACCESS, ASSIGN, ENDPOINT, KINDS, LONG_HEX, SCOPE
from sedge.llm.substring_dedup import WINDOW

WORDS = f"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from t),
k as (select doc_id, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') as path from (select doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) as p from t where len(ws) >= {WINDOW}) x),
late as (select k.doc_id, k.p from k join (select path, min(doc_id) as first_doc from k group by path) f on k.path = f.path where f.first_doc < k.doc_id),
gone as (select distinct doc_id, unnest(generate_series(p, p + {WINDOW - 1})) as i from late),
left_over as (select w.doc_id, count(*) as n, string_agg(w.word, ' ' order by w.i) as kept from w anti join gone on w.doc_id = gone.doc_id and w.i = gone.i group by w.doc_id)
select t.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from t left join left_over on t.doc_id = left_over.doc_id"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kind: int, pattern: str, keep: str, test: str = "true") -> str:
    """Places follow from the texts between matches; group g holds what `keep` looks at."""
    p = _q(pattern)
    return f"""select doc_id, {kind} as kind, s as start, s + length(m) as "end", m, v from (
      select doc_id, unnest(ms) as m, unnest(vs) as v, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) as s
      from (select doc_id, regexp_extract_all(text, {p}, 0) as ms, regexp_extract_all(text, {p}, {2 if kind == 0 else 0}) as vs, string_split_regex(text, {p}) as gaps from t where {test}) a where len(ms) > 0) b where {keep}"""


#: A bare key is a whole run of its letters; this engine has no look-around.
_RUN = "[A-Za-z0-9/+=]+"
_ENDPOINT = ENDPOINT.replace("\\s", "\\x20\\x09-\\x0D")
_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_JOINED = f"""string_agg({_NAMES}[kind + 1] || ':' || cast(start as bigint) || ':' || cast("end" as bigint), ',' order by start, kind, "end")"""
_NEAR = f"""greatest(a.start, b.start) - least(a."end", b."end") <= {SCOPE}"""

SECRETS = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
base as ({_spans(0, ASSIGN, "length(v) >= 6")} union all {_spans(1, ACCESS, "length(m) >= 20")} union all {_spans(2, LONG_HEX, "true")}),
ids as (select * from base where kind = 1),
bare as ({_spans(3, _RUN, "length(m) = 40 and not contains(m, '=')", "contains(text, 'AKIA')")}),
ends as ({_spans(4, _ENDPOINT, "true", "contains(text, 'AKIA')")}),
keys as (select a.* from bare a semi join ids b on a.doc_id = b.doc_id and {_NEAR}),
near as (select a.* from ends a semi join ids b on a.doc_id = b.doc_id and {_NEAR}),
paired as (select a.* from near a semi join (select * from keys union all select * from base where kind = 0) b on a.doc_id = b.doc_id and {_NEAR}),
b as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, {_JOINED} as line from base group by doc_id),
e as (select doc_id, {_JOINED} as line from (select * from base union all select * from keys union all select * from paired) x group by doc_id)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b.line, '')) as base_sha256, coalesce(e.line, '') as spans
from t left join b on t.doc_id = b.doc_id left join e on t.doc_id = e.doc_id"""

VECTORS = f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
n as (select vec_id, label, len(x) as d, x, sqrt(list_dot_product(x, x)) as norm from v),
link as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.d = b.d and a.vec_id <> b.vec_id where list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {COSINE}),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join link l on r.b = l.a),
low as (select a, min(b) as component_id from reach group by a)
select e.vec_id, cast(coalesce(c.n, 0) as bigint) as n_links, low.component_id, e.vec_id = low.component_id as kept
from embeddings e join low on e.vec_id = low.a left join (select a, count(*) as n from link group by a) c on e.vec_id = c.a"""

ORACLES = {"op2_secret_scan": SECRETS, "op3_substring_dedup": WORDS, "op9_embedding_dedup": VECTORS}
