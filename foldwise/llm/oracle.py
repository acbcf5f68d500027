"""DuckDB SQL of the training-data queries that SQL can express, over the same whole tables."""

# all pairs that share a word triple, exact similarities, transitive closure
JACCARD_JOIN_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) i from w where len(w) > 0) x),
n as (select doc_id, count(*) n from s group by doc_id),
sets as (select doc_id, string_agg(md5(g), '' order by g) k from s group by doc_id),
cls as (select doc_id, min(doc_id) over (partition by md5(k)) rep from sets),
r as (select s.* from s join cls on cls.doc_id = s.doc_id where cls.rep = cls.doc_id),
pairs as (select a.doc_id a, b.doc_id b, count(*) c from r a join r b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select reach.a, both_ways.b from reach join both_ways on both_ways.a = reach.b),
comp as (select a, least(a, min(b)) c from reach group by a)
select w.doc_id, coalesce(n.n, 0) n_shingles, coalesce(comp.c, cls.rep, w.doc_id) component_id
from w left join n on n.doc_id = w.doc_id left join cls on cls.doc_id = w.doc_id left join comp on comp.a = cls.rep
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# integer arithmetic as stated, over every document and item
SEARCH_SQL = rf"""
with d as (select row_number() over () row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
size as (select row_id, doc_id, len(t) n from d where len(t) > 0),
total as (select count(*) n_docs, cast(sum(n) as bigint) n_terms from size),
tf as (select row_id, term, count(*) tf from (select row_id, unnest(t) term from d) x group by all),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) w
      from tf, total where term in (select term from q) group by term, n_docs),
scored as (select q.item_id, s.row_id, s.doc_id,
                  sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * s.n * total.n_docs) // total.n_terms)))) score
           from q join tf on tf.term = q.term join w on w.term = q.term join size s on s.row_id = tf.row_id cross join total group by all),
ranked as (select item_id, doc_id, cast(score as bigint) score,
                  cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) rank
           from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


def _merkle_sql(lower: int = 7, upper: int = 4) -> str:
    """Level by level: ``lower`` levels over the rows of a source, ``upper`` levels over the sources (16 ** levels each)."""
    h = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(h(text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    parts = [f"""crc_table as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
docs as (select *, row_number() over () row_id, {leaf('text')} leaf, coalesce('+' || source, '') tree,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(cast(doc_id as varchar)) + 1),
      lambda i: cast(ascii(substr(cast(doc_id as varchar), i, 1)) as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 tampered,
  {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} lowered from documents, crc_table),
l0 as (select tree, row_number() over (partition by tree order by doc_id nulls first, leaf, row_id) - 1 i, leaf d, row_id,
  case when tampered then lowered else leaf end g, '' p from docs),
lway0 as (select row_id, tree, i, g, p from l0),
ln0 as (select tree, i, d from l0)"""]

    def climb(prefix: str, levels: int) -> None:
        # a tree that has one node left stays as it is
        for k in range(levels):
            parts.append(f"""{prefix}c{k} as (select tree, count(*) c from {prefix}n{k} group by tree),
{prefix}r{k} as (select n.tree, i // 16 j, list(d order by i) ds, any_value(c) c
  from {prefix}n{k} n join {prefix}c{k} using (tree) group by n.tree, i // 16),
{prefix}n{k + 1} as (select tree, j i, case when c = 1 then ds[1] else sha256(array_to_string(ds, '')) end d from {prefix}r{k}),
{prefix}way{k + 1} as (select w.row_id, w.tree, w.i // 16 i,
  case when c = 1 then w.g else sha256(array_to_string(ds[1:w.i % 16], '') || w.g || array_to_string(ds[w.i % 16 + 2:], '')) end g,
  case when c = 1 then w.p else w.p || array_to_string(ds[1:w.i % 16], '') || array_to_string(ds[w.i % 16 + 2:], '') end p
  from {prefix}way{k} w join {prefix}r{k} r on r.tree = w.tree and r.j = w.i // 16)""")

    climb("l", lower)
    parts.append(f"""un0 as (select 0 tree, row_number() over (order by encode(tree)) - 1 i, d, tree src from ln{lower}),
uway0 as (select w.row_id, 0 tree, u.i, w.g, w.p from lway{lower} w join un0 u on u.src = w.tree)""")
    climb("u", upper)
    return f"""with {', '.join(parts)}
select docs.doc_id, docs.leaf, ln{lower}.d subroot, un{upper}.d root, sha256(w.p) proof_sha256, w.g folded_root, w.g = un{upper}.d verified
from docs join uway{upper} w on w.row_id = docs.row_id join ln{lower} on ln{lower}.tree = docs.tree cross join un{upper}"""


MERKLE_SQL = _merkle_sql()
