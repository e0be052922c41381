"""Registered queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages
from ..operators import context, entities, files, graph, merkle, parse, skew, snapshots, vectors
from ..sources.tables import table
from ..storage import materialize, scratch_path
from . import pipeline

CALL_KEYS = ("callee", "file_path")
QUARTILES = (0.25, 0.5, 0.9)



def _edges(s, d):
    return graph.build_edges(table(s, d, "calls"), table(s, d, "entities"))


def _last_snapshot(nodes):
    last = nodes.agg(F.max("snapshot_id").alias("last"))
    return merkle.snapshot_files(nodes).join(F.broadcast(last), F.col("snapshot_id") == F.col("last")).select("path", "hash")  # one row


def _roundtrip(s, d):
    path = scratch_path(s, "saved-snapshot")
    merkle.save_snapshot(snapshots.normalized_nodes(table(s, d, "nodes")), path)
    return merkle.load_snapshot(s, path)


def _by_id(s, d, group=None):
    rows = table(s, d, "embeddings")
    return rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), *([F.col(group).alias("group")] if group else []))


def _file_search(s, d):
    rows = vectors.keep_last_vector(table(s, d, "file_vectors").select("id", "embedding")).where("size(embedding) = 384")
    asked = rows.where("conv(substring(id, 1, 8), 16, 10) % 20 = 0")
    return vectors.search(rows, asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 3)


def _chain_pairs(s, d):
    """For every file with edges: from the caller that was indexed last to the callee that was indexed first."""
    own = entities.keep_last(table(s, d, "entities")).select("id", "file_path", "seq")
    edges = _edges(s, d)
    out = edges.select(F.col("src").alias("id")).distinct().join(own, "id").groupBy("file_path").agg(F.max(F.struct("seq", "id")).alias("a"))
    into = edges.select(F.col("dst").alias("id")).distinct().join(own, "id").groupBy("file_path").agg(F.min(F.struct("seq", "id")).alias("b"))
    return out.join(into, "file_path").select(F.col("a.id").alias("start"), F.col("b.id").alias("goal"))


def _upsert(s, d):
    """Functions get a new document; other rows stay."""
    rows = vectors.keep_last_vector(table(s, d, "entity_vectors").select("id", "document", "type", "file_path"))
    return vectors.upsert(rows, rows.where("type = 'function'").withColumn("document", F.concat(F.lit("v2 "), F.coalesce("document", F.lit("")))))


def _delete_dead(s, d):
    """Without vectors of files that the last snapshot doesn't have."""
    rows = vectors.keep_last_vector(table(s, d, "entity_vectors").select("id", "file_path"))
    live = _last_snapshot(table(s, d, "nodes")).select("path")
    gone = rows.select(F.col("file_path").alias("path")).distinct().join(live, "path", "left_anti")
    return vectors.delete_files(rows, gone).select("id", "file_path")


def _embedded(s, d):
    rows = vectors.keep_last_vector(table(s, d, "file_vectors").select("id", "document"))
    return vectors.embed(vectors.fit_embedder(rows), rows)


def _search_code(s, d):
    """Every class name asked as a question, over the documents of the entities."""
    rows = vectors.keep_last_vector(table(s, d, "entity_vectors").select("id", "document", "type"))
    model = vectors.fit_embedder(rows)
    asked = entities.first_matches(table(s, d, "entities").where("type = 'class'")).select(F.col("name").alias("query_id"), F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2").alias("document"))
    return vectors.search(vectors.embed(model, rows), vectors.embed(model, asked).select("query_id", F.col("embedding").alias("vector")), 5)


def _summaries(s, d):
    """The name of the first entity of each file as its summary."""
    return table(s, d, "entities").where("file_path is not null and seq is not null").groupBy(F.col("file_path").alias("path")).agg(F.min_by(F.coalesce("name", F.lit("")), F.struct("seq", "id")).alias("summary"))


def _export(s, d):
    return graph.export(_edges(s, d), table(s, d, "entities"), graph.file_dependencies(graph.build_global_edges(table(s, d, "calls"), table(s, d, "entities"))))


def _context(s, d):
    hits = vectors.keep_last_vector(table(s, d, "entity_vectors").select("id", "document"))
    return context.minimal_context(hits, _edges(s, d), table(s, d, "entities"))


def _question_contexts(s, d):
    """Vectors of entities as questions: ids whose digest is divisible by 20, against all rows."""
    rows = table(s, d, "entity_vectors")
    asked = vectors.keep_last_vector(rows.select("id", "embedding")).where("size(embedding) = 384 and conv(substring(md5(id), 1, 8), 16, 10) % 20 = 0")
    return context.question_contexts(asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), rows, _edges(s, d), table(s, d, "entities"))


def _entity_context(s, d):
    rows = graph.entity_context(_edges(s, d), table(s, d, "entities"))
    return rows.withColumns({c: F.to_json(c) for c in ("calls", "called_by")})


# One source per part: extension, text with {k} for the key, and what it defines (name, type, start, end, parent) and calls (caller, callee, line).
MADE = {
    "c": ("c", "#include <a.h>\n\nstruct s{k} {\n  int x;\n};\n\nint h{k}(int x) {\n  return x;\n}\n\nint m{k}(int x) {\n  return h{k}(x);\n}\n",
          (("s{k}", "struct", 3, 5, None), ("h{k}", "function", 7, 9, None), ("m{k}", "function", 11, 13, None)), ("m{k}", "h{k}", 12)),
    "go": ("go", "package p\n\ntype s{k} struct {\n\tx int\n}\n\nfunc h{k}(x int) int {\n\treturn x\n}\n\nfunc (r *s{k}) m{k}(x int) int {\n\treturn h{k}(x)\n}\n",
           (("s{k}", "struct", 3, 5, None), ("h{k}", "function", 7, 9, None), ("m{k}", "method", 11, 13, "s{k}")), ("m{k}", "h{k}", 12)),
    "java": ("java", "package p;\n\nclass C{k} {\n  C{k}(int x) {\n    h{k}(x);\n  }\n\n  int h{k}(int x) {\n    return x;\n  }\n}\n",
             (("C{k}", "class", 3, 11, None), ("C{k}", "constructor", 4, 6, "C{k}"), ("h{k}", "method", 8, 10, "C{k}")), ("C{k}", "h{k}", 5)),
    "javascript": ("js", "class C{k} {\n  m{k}(a) {\n    return h{k}(a);\n  }\n}\n\nfunction h{k}(x) {\n  return x;\n}\n",
                   (("C{k}", "class", 1, 5, None), ("m{k}", "method", 2, 4, "C{k}"), ("h{k}", "function", 7, 9, None)), ("m{k}", "h{k}", 3)),
    "python": ("py", "class C{k}:\n    def m{k}(self):\n        return h{k}(1)\n\n\ndef h{k}(x):\n    return x\n",
               (("C{k}", "class", 1, 3, None), ("m{k}", "method", 2, 3, "C{k}"), ("h{k}", "function", 6, 7, None)), ("m{k}", "h{k}", 3)),
}


def made_files(part, languages_=tuple(MADE)):
    """``(path, content, hash)``: a source in every language for each part."""
    kinds = F.array(*[F.struct(F.lit(MADE[x][0]).alias("ext"), F.lit(MADE[x][1]).alias("text")) for x in languages_])
    rows = part.select(F.col("p_partkey").cast("string").alias("k"), F.explode(kinds).alias("m")).select(F.concat(F.lit("made/f"), "k", F.lit("."), "m.ext").alias("path"), F.replace("m.text", F.lit("{k}"), F.col("k")).alias("text"))
    return rows.select("path", F.encode("text", "UTF-8").alias("content"), F.sha2("text", 256).alias("hash"))


def _parsed_made(language):
    return lambda s, d: parse.entities_of(parse.parsed(made_files(table(s, d, "part"), (language,)))).select("file_path", "name", "type", "start_line", "end_line", "parent_class")


def _made_edges(s, d):
    """From contents to edges: both row kinds of one parse, then resolution."""
    rows = materialize(parse.parsed(made_files(table(s, d, "part"))), "made-parsed")
    return graph.build_edges(parse.calls_of(rows), parse.entities_of(rows))


def _made_increment(s, d):
    """Entities of the files that differ from an older snapshot, which lacks every fifth part and has another hash for every third."""
    files_ = made_files(table(s, d, "part"))
    key = F.regexp_extract("path", r"f(\d+)\.", 1).cast("long")
    old = files_.where(key % 5 != 0).select("path", F.when(key % 3 == 0, F.lit("other")).otherwise(F.col("hash")).alias("hash"))
    return pipeline.changed_entities(files_, pipeline.changes(old, files_)).select("file_path", "name", "type", "start_line", "end_line", "parent_class")


def _incremental(s, d):
    nodes = table(s, d, "nodes")
    last = nodes.agg(F.max("snapshot_id").alias("last"))
    status = merkle.file_changes(nodes, unchanged=False).join(F.broadcast(last), F.col("snapshot_id") == F.col("last"))  # one row
    return pipeline.changed_entities(table(s, d, "files"), status.select("path", "status"))


QUERIES = {
    "scan_language": lambda s, d: files.with_language(table(s, d, "files")),
    "scan_extensions": lambda s, d: files.scanned(table(s, d, "files")),
    "filter_tracked": lambda s, d: files.tracked_paths(table(s, d, "files")),
    "filter_skip_dirs": lambda s, d: files.unskipped_paths(table(s, d, "files")),
    "content_hash": lambda s, d: files.content_hashes(table(s, d, "files")),
    "text_lengths": lambda s, d: files.text_lengths(table(s, d, "files")),
    "file_text": lambda s, d: files.file_text(table(s, d, "files")).select("path", "document"),
    "file_text_summaries": lambda s, d: files.file_text(table(s, d, "files"), _summaries(s, d)),
    "strip_hash_lines": lambda s, d: files.code_without_comments(table(s, d, "files")),
    "verify_file": lambda s, d: files.verify(table(s, d, "files"), _last_snapshot(table(s, d, "nodes"))),
    "merkle_dir_hash": lambda s, d: merkle.directory_hashes(merkle.snapshot_files(table(s, d, "nodes"))),
    "merkle_root": lambda s, d: merkle.directory_hashes(merkle.snapshot_files(table(s, d, "nodes"))).where("path = '.'").select("snapshot_id", "hash"),
    "snapshot_diff": lambda s, d: merkle.file_changes(table(s, d, "nodes")),
    "snapshot_diff_counts": lambda s, d: merkle.change_counts(table(s, d, "nodes")),
    "subtree_files": lambda s, d: merkle.subtree_files(table(s, d, "nodes")),
    "snapshot_file_counts": lambda s, d: merkle.file_counts(table(s, d, "nodes")),
    "snapshot_roundtrip": _roundtrip,
    "entity_id": lambda s, d: entities.entity_id(table(s, d, "entities")),
    "entities_dedup_last": lambda s, d: entities.keep_last(table(s, d, "entities")),
    "entities_per_file": lambda s, d: entities.per_file(table(s, d, "entities")),
    "entity_first_match": lambda s, d: entities.first_matches(table(s, d, "entities")),
    "count_by_type": lambda s, d: entities.count_by_type(table(s, d, "entities")),
    "line_slice": lambda s, d: entities.line_slices(table(s, d, "entities"), table(s, d, "files")),
    "entity_text": lambda s, d: entities.entity_text(table(s, d, "entities"), table(s, d, "files")),
    "resolve_calls": lambda s, d: graph.resolve_calls(table(s, d, "calls"), table(s, d, "entities")),
    "build_edges": _edges,
    "build_edges_global": lambda s, d: graph.build_global_edges(table(s, d, "calls"), table(s, d, "entities")),
    "file_deps": lambda s, d: graph.file_dependencies(graph.build_global_edges(table(s, d, "calls"), table(s, d, "entities"))),
    "entity_deps": lambda s, d: graph.degrees(_edges(s, d)),
    "entity_context": _entity_context,
    "entity_neighbours": lambda s, d: graph.entity_neighbours(_edges(s, d), table(s, d, "entities")),
    "impact_depth3": lambda s, d: graph.impact(_edges(s, d)),
    "impact_by_file": lambda s, d: graph.impact_by_file(_edges(s, d)),
    "change_report": lambda s, d: context.change_report(_edges(s, d)),
    "call_chain": lambda s, d: graph.call_chains(_edges(s, d), _chain_pairs(s, d)),
    "scc": lambda s, d: graph.components(_edges(s, d), entities.keep_last(table(s, d, "entities"))),
    "graph_stats": lambda s, d: graph.statistics(_edges(s, d), table(s, d, "entities")),
    "graph_export_json": _export,
    "knn_entities": lambda s, d: vectors.search(*_by_id(s, d), 5, "vec_id"),
    "knn_filtered": lambda s, d: vectors.search(*_by_id(s, d, "label"), 5, "vec_id", group_col="label"),
    "knn_files": _file_search,
    "vector_stats": lambda s, d: vectors.statistics(table(s, d, "entity_vectors"), table(s, d, "file_vectors")),
    "vector_upsert": _upsert,
    "vector_delete_file": _delete_dead,
    "embed_hashing": _embedded,
    "search_code": _search_code,
    "minimal_context": _context,
    "token_estimate": lambda s, d: context.token_estimates(table(s, d, "entity_vectors")),
    "question_contexts": _question_contexts,
    "token_totals": lambda s, d: context.token_totals(_question_contexts(s, d), table(s, d, "files")),
    "project_summary": lambda s, d: context.summary(table(s, d, "files"), table(s, d, "entities"), _edges(s, d)),
    "file_tree_top5": lambda s, d: context.file_tree(table(s, d, "files")),
    "file_tree_depth3": lambda s, d: context.file_tree(table(s, d, "files"), 5, 3),
    "parse_entities": lambda s, d: parse.entities_of(parse.parsed(table(s, d, "files"))),
    "extract_calls": lambda s, d: parse.calls_of(parse.parsed(table(s, d, "files"))),
    **{f"parse_{x}": _parsed_made(x) for x in MADE},
    "extract_calls_made": lambda s, d: parse.calls_of(parse.parsed(made_files(table(s, d, "part")))).select("file_path", "caller", "callee", "line_number"),
    "parsed_edges": _made_edges,
    "incremental_made": _made_increment,
    "language_stats": lambda s, d: parse.availability(s),
    "incremental_index": _incremental,
    "p1_found": lambda s, d: skew.heavy_keys(table(s, d, "calls"), CALL_KEYS, "seq").select("field", "key_value"),
    "p1_key_quantiles": lambda s, d: skew.key_profile(table(s, d, "calls"), CALL_KEYS, "seq", "line_number", QUARTILES),
    "p1_key_times": lambda s, d: skew.key_profile(table(s, d, "calls").withColumn("at", F.unix_micros(F.col("indexed_at").cast("timestamp"))), CALL_KEYS, "seq", "at", (0.5,)),
    "p6_found": lambda s, d: snapshots.snapshot_changes(table(s, d, "nodes")),
    "p6_changed_values": lambda s, d: snapshots.changed_values(table(s, d, "nodes")),
}

ORACLES: dict[str, str] = {}

_PROFILE = """
with c as (select distinct {f} as k, seq from calls where seq is not null),
n as (select k, count(*) as n from c where k is not null group by k),
t as (select count(distinct seq) as total from calls),
v as (select k, seq, min(x) as v from (select {f} as k, seq, {x} as x from calls where seq is not null and {x} is not null) group by k, seq),
q as (select k, unnest({q}::double[]) as q, unnest(quantile_disc(v, {q}))::bigint as v from v group by k)
select '{f}' as field, n.k as key_value, n.n as n_events, t.total as total_events, q.q as q, q.v as v
from n cross join t left join q on q.k = n.k"""
ORACLES["p1_found"] = " union all ".join(f"""
select '{f}' as field, {f} as key_value from calls where {f} is not null group by {f}
having count(distinct seq) >= 0.02 * (select count(distinct seq) from calls)""" for f in CALL_KEYS)
ORACLES["p1_key_quantiles"] = " union all ".join(f"select * from ({_PROFILE.format(f=f, x='line_number', q=list(QUARTILES))})" for f in CALL_KEYS)
ORACLES["p1_key_times"] = " union all ".join(f"select * from ({_PROFILE.format(f=f, x='epoch_us(indexed_at)', q=[0.5])})" for f in CALL_KEYS)
_SNAPSHOTS = r"""
with r as (select snapshot_id, nfc_normalize(regexp_replace(replace(path, chr(92), '/'), '^(\./+)+', '')) as path, lower(hash) as hash, is_file, loaded_at
           from nodes where snapshot_id is not null and path is not null),
b as (select snapshot_id, path, hash, is_file from r
      qualify row_number() over (partition by snapshot_id, path order by loaded_at desc nulls last, hash desc nulls last, is_file desc nulls last) = 1),
i as (select snapshot_id, lag(snapshot_id) over (order by snapshot_id) as before from (select distinct snapshot_id from b)),
n as (select i.snapshot_id, b.path, b.hash, b.is_file from i join b on b.snapshot_id = i.snapshot_id where i.before is not null),
o as (select i.snapshot_id, b.path, b.hash, b.is_file from i join b on b.snapshot_id = i.before),
x as (select coalesce(n.snapshot_id, o.snapshot_id) as snapshot_id, coalesce(n.path, o.path) as path,
      case when o.path is null then 'added' when n.path is null then 'deleted'
           when n.hash is distinct from o.hash or n.is_file is distinct from o.is_file then 'modified' end as status, o.hash as old_hash, n.hash as new_hash
      from n full join o on n.snapshot_id = o.snapshot_id and n.path = o.path)
"""
ORACLES["p6_found"] = _SNAPSHOTS + "select snapshot_id, path, status from x where status is not null"
ORACLES["p6_changed_values"] = _SNAPSHOTS + "select snapshot_id, path, status, old_hash, new_hash from x where status is not null"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_NAME = "regexp_extract(path, '[^/]*$')"
_EXT = rf"regexp_extract({_NAME}, '{languages.EXTENSION_RE}', 1)"
_LANG = f"case {' '.join(f"when lower({_EXT}) in ({_list(sorted(e for e, x in languages.LANGUAGES.items() if x == lang))}) then '{lang}'" for lang in sorted(set(languages.LANGUAGES.values())))} end"
_TEXT = r"regexp_replace(regexp_replace(decode(content), chr(13) || chr(10), chr(10), 'g'), chr(13), chr(10), 'g')"
_STRIP = r"regexp_replace(array_to_string(list_filter(string_split({t}, chr(10)), lambda x: not starts_with(x, '#')), chr(10)), '^\s+|\s+$', '', 'g')"
_PARENT = "case when contains(path, '/') then regexp_extract(path, '^(.*)/[^/]*$', 1) else '.' end"
_ENT = """ent as (select * from (select id, name, type, file_path, start_line, end_line, signature, parent_class, docstring, seq from entities where id is not null)
  qualify row_number() over (partition by id order by seq desc nulls last, name desc nulls last, type desc nulls last, file_path desc nulls last, start_line desc nulls last,
  end_line desc nulls last, signature desc nulls last, parent_class desc nulls last, docstring desc nulls last) = 1)"""
_FILES = _SNAPSHOTS.strip().removesuffix(")").rpartition("i as (")[0].rstrip().rstrip(",") + ", sf as (select snapshot_id, path, hash from b where is_file)"
_SITES = """sites as (select file_path, caller, callee, max_by(line_number, seq) as line, max(seq) as seq from calls
  where caller is not null and callee is not null and file_path is not null group by all),
names as (select distinct file_path as f, name as n from ent),
res as (select s.file_path || '::' || s.caller as src, s.file_path || '::' || coalesce(a.n, b.n) as dst, s.seq, s.line from sites s
  left join names a on a.f = s.file_path and a.n = s.callee left join names b on b.f = s.file_path and b.n = split_part(s.callee, '.', -1) where coalesce(a.n, b.n) is not null)"""
_EDGES = f"""{_ENT}, {_SITES},
edges as (select src, dst, max_by(line, seq) as line from res where src in (select id from ent) and dst in (select id from ent) group by src, dst)"""
_GLOBAL = f"""{_EDGES},
uniq as (select name as un, max(id) as target from ent where name is not null group by name having count(*) = 1),
wide as (select s.file_path || '::' || s.caller as src, coalesce(a.target, b.target) as dst, s.line, s.seq from sites s
  left join uniq a on a.un = s.callee left join uniq b on b.un = split_part(s.callee, '.', -1) where s.file_path || '::' || s.caller in (select id from ent) and coalesce(a.target, b.target) is not null),
alledges as (select src, dst, line from edges union all select src, dst, max_by(line, seq) as line from wide where (src, dst) not in (select (src, dst) from edges) group by src, dst)"""
_LINES = f"lines as (select path, max(string_split({_TEXT}, chr(10))) as lines from files where content is not null group by path)"
_SLICE = f"""{_ENT}, {_LINES},
code as (select id, array_to_string(lines[greatest(start_line, 1):end_line], chr(10)) as code from ent join lines on file_path = path where start_line is not null and end_line >= start_line)"""
_IMPACT = """walk as (select distinct dst as seed, dst as id, 0 as depth from edges
  union select w.seed, e.src, w.depth + 1 from walk w join edges e on e.dst = w.id where w.depth < 3),
imp as (select distinct seed, id from walk where id <> seed)"""
_FILE_OF = r"regexp_extract({0}, '^(.*)::[^:]*$', 1)"
_NEAR = """near as (select distinct id, direction, other, name, file from (select src as id, 'calls' as direction, dst as other from edges union all select dst, 'called_by', src from edges)
  join (select id as other, name, file_path as file from ent) using (other)),
first3 as (select id, direction, string_agg('- ' || name, ', ' order by name, file, other) as list from near qualify_ where r <= 3 group by id, direction)""".replace(
    "near qualify_", "(select *, row_number() over (partition by id, direction order by name, file, other) as r from near)")
_SPAN = "coalesce(start_line::varchar, '?') || '-' || coalesce(end_line::varchar, '?')"
_CONTEXT = f"""parts as (select ent.id, concat_ws(chr(10), chr(10) || '## ' || upper(type[1]) || lower(type[2:]) || ': ' || name, 'File: ' || file_path || ' (lines ' || {_SPAN} || ')', 'Calls: ' || c.list, 'Called by: ' || b.list,
  chr(10) || repeat('`', 3) || 'python', {_STRIP.format(t='v.document')}, repeat('`', 3) || chr(10)) as context
  from (select id, max(document) as document from entity_vectors where id is not null group by id) v join ent on ent.id = v.id
  left join first3 c on c.id = ent.id and c.direction = 'calls' left join first3 b on b.id = ent.id and b.direction = 'called_by' where v.document is not null and name is not null)"""
_ASKED = """v as (select id, max(embedding) as e from entity_vectors where id is not null group by id), u as (select * from v where len(e) = 384),
hits as (select q.id as query_id, u.id as id, list_sum(list_transform(list_zip(q.e, u.e), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as exact
  from u q, u where ('0x' || substr(md5(q.id), 1, 8))::bigint % 20 = 0 qualify row_number() over (partition by q.id order by exact, u.id) <= 5),
asked as (select query_id, count(*)::bigint as n_hits, concat_ws(chr(10), '# Relevant Code Context' || chr(10), string_agg(context, chr(10) order by round(exact, 6), id)) as context
  from hits left join parts using (id) group by query_id)"""
_REACH = """reach as (select distinct src, dst from edges where src <> dst union select r.src, e.dst from reach r join edges e on e.src = r.dst),
both_ as (select a.src as id, a.dst as other from reach a join reach b on a.src = b.dst and a.dst = b.src),
comp as (select ent.id, coalesce(least(ent.id, min(other)), ent.id) as component from ent left join both_ on both_.id = ent.id group by ent.id)"""
_VEC = "(select id, max(document) as document, max(file_path) as file_path, max(type) as type from entity_vectors where id is not null group by id)"


def _merkle(levels: int = 12) -> str:
    parts = [f"f as (select snapshot_id, path, hash, len(string_split(path, '/')) as level from sf where hash is not null)"]
    for n in range(levels, 0, -1):
        below = f"select snapshot_id, path, hash from f where level = {n}" + (f" union all select snapshot_id, path, hash from m{n}" if n < levels else "")
        parts.append(f"m{n - 1} as (select snapshot_id, {_PARENT} as path, sha256(string_agg(hash, '' order by hash)) as hash from ({below}) group by all)")
    return _FILES + ", " + ", ".join(parts), " union all ".join(f"select * from m{n}" for n in range(levels))


_MERKLE, _MADE = _merkle()
_CHANGES = _FILES + """,
i as (select snapshot_id, lead(snapshot_id) over (order by snapshot_id) as newer from (select distinct snapshot_id from nodes where snapshot_id is not null)),
o as (select i.newer as snapshot_id, path, hash from sf join i using (snapshot_id) where i.newer is not null),
n as (select snapshot_id, path, hash from sf where snapshot_id > (select min(snapshot_id) from nodes)),
ch as (select coalesce(n.snapshot_id, o.snapshot_id) as snapshot_id, coalesce(n.path, o.path) as path,
  case when o.path is null then 'added' when n.path is null then 'deleted' when n.hash is not distinct from o.hash then 'unchanged' else 'modified' end as status
  from n full join o on n.snapshot_id = o.snapshot_id and n.path = o.path)"""
_LAST = _FILES + ", last as (select path, hash from sf where snapshot_id = (select max(snapshot_id) from nodes))"
_KNN = """select query_id, id, distance from (select q.vec_id as query_id, x.vec_id as id, round(list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) as distance,
  list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as exact
  from embeddings q join embeddings x on {on} where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by exact, x.vec_id) <= {k})"""
_TREE = """with d as (select distinct path from files where path is not null and len(string_split(path, '/')) <= {depth}),
e as (select {parent} as directory, regexp_extract(path, '([^/]*)$', 1) as name from d)
select directory, count(*)::bigint as n_files, array_to_string(list(name order by name)[1:5], ', ') || case when count(*) > 5 then ', ... and ' || (count(*) - 5) || ' more' else '' end as listing from e group by directory"""

ORACLES |= {
    "scan_language": f"select distinct path, {_LANG} as language from files where path is not null",
    "scan_extensions": f"select distinct path from files where {_EXT} in ({_list(languages.SCANNED)})",
    "filter_tracked": f"""select distinct path from files where len(list_filter(string_split(path, '/')[:-2], lambda p: regexp_matches(p, '{languages.IGNORED_DIRECTORY_RE}'))) = 0
        and not regexp_matches({_NAME}, '{languages.IGNORED_NAME_RE}') and not regexp_matches(path, '{languages.IGNORED_PATH_RE}')
        and (lower({_EXT}) in ({_list(languages.TRACKED_EXTENSIONS)}) or regexp_matches({_NAME}, '{languages.IMPORTANT_RE}'))""",
    "filter_skip_dirs": f"select distinct path from files where not list_has_any(string_split(path, '/'), [{_list(languages.SKIPPED_DIRECTORIES)}])",
    "content_hash": "select distinct path, sha256(content) as hash, octet_length(content)::bigint as size from files",
    "text_lengths": f"select distinct path, length(coalesce({_TEXT}, ''))::bigint as n_chars, len(string_split(coalesce({_TEXT}, ''), chr(10)))::bigint as n_lines from files",
    "file_text": f"select distinct path, '# File: ' || path || chr(10) || {_TEXT} as document from files where content is not null",
    "file_text_summaries": f"""with s as (select file_path, min_by(coalesce(name, ''), (seq, id)) as summary from entities where file_path is not null and seq is not null group by file_path)
        select distinct path, concat_ws(chr(10), '# File: ' || path, '# Summary: ' || nullif(summary, ''), {_TEXT}) as document, summary is not null as has_summary from files left join s on file_path = path where content is not null""",
    "strip_hash_lines": f"select distinct path, {_STRIP.format(t=_TEXT)} as code from files where content is not null",
    "verify_file": f"{_LAST} select last.path, coalesce(last.hash = f.hash, false) as verified from last left join (select distinct path, sha256(content) as hash from files where content is not null) f on f.path = last.path",
    "merkle_dir_hash": f"{_MERKLE} {_MADE}",
    "merkle_root": f"{_MERKLE} select snapshot_id, hash from m0",
    "snapshot_diff": f"{_CHANGES} select * from ch",
    "snapshot_diff_counts": f"{_CHANGES} select snapshot_id, " + ", ".join(f"count(*) filter (status = '{x}')::bigint as {x}" for x in ("added", "modified", "deleted", "unchanged")) + " from ch group by snapshot_id",
    "subtree_files": f"""{_FILES}, x as (select snapshot_id, path, unnest(range(1, len(string_split(path, '/')))) as k from sf)
        select snapshot_id, array_to_string(string_split(path, '/')[1:k], '/') as directory, count(*)::bigint as n_files from x group by all""",
    "snapshot_file_counts": f"{_FILES} select snapshot_id, count(*)::bigint as n_files from sf group by snapshot_id",
    "snapshot_roundtrip": f"{_FILES} select snapshot_id, path, hash, is_file from b",
    "entity_id": "select seq, file_path || '::' || name as id from entities",
    "entities_dedup_last": f"with {_ENT} select * from ent",
    "entities_per_file": f"with {_ENT} select file_path, count(*)::bigint as n_entities, string_agg(distinct name, ',' order by name) as names from ent where file_path is not null group by file_path",
    "entity_first_match": "select name, min_by(id, (seq, id)) as id, min(seq) as seq from entities where name is not null and seq is not null group by name",
    "count_by_type": f"with {_ENT} select type, count(*)::bigint as n from ent group by type",
    "line_slice": f"with {_SLICE} select id, code from code",
    "entity_text": f"""with {_SLICE} select ent.id, concat_ws(chr(10), '# ' || type || ': ' || name, '# File: ' || file_path, '# Class: ' || nullif(parent_class, ''), '# Documentation: ' || nullif(docstring, ''), code) as document
        from ent join code on code.id = ent.id""",
    "resolve_calls": f"with {_ENT}, {_SITES} select * from res",
    "build_edges": f"with {_EDGES} select * from edges",
    "build_edges_global": f"with {_GLOBAL} select * from alledges",
    "file_deps": f"with {_GLOBAL} select {_FILE_OF.format('src')} as from_file, {_FILE_OF.format('dst')} as to_file, 'call' as type, count(*)::bigint as n from alledges where {_FILE_OF.format('src')} <> {_FILE_OF.format('dst')} group by all",
    "entity_deps": f"with {_EDGES} select id, sum(o)::bigint as n_calls, sum(i)::bigint as n_called_by from (select src as id, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges) group by id",
    "entity_context": f"""with {_EDGES}, {_NEAR}, lists as (select id, direction, to_json(list({{'name': name, 'file': file}} order by name, file))::varchar as list from near group by id, direction)
        select ent.id, name, type, file_path, {_SPAN} as lines, parent_class, coalesce(c.list, '[]') as calls, coalesce(b.list, '[]') as called_by from ent
        left join lists c on c.id = ent.id and c.direction = 'calls' left join lists b on b.id = ent.id and b.direction = 'called_by'""",
    "entity_neighbours": f"with {_EDGES}, {_NEAR} select id, direction, other, name, file from near",
    "change_report": f"""with recursive {_EDGES}, {_IMPACT}, p as (select distinct {_FILE_OF.format('seed')} as changed_file, id from imp),
        f as (select changed_file, {_FILE_OF.format('id')} as file_path, count(*) as n, list(distinct regexp_extract(id, '([^:]*)$', 1)) as names from p group by all),
        l as (select changed_file, file_path, n, file_path || ': ' || array_to_string(list_sort(names)[1:3], ', ') as line from f)
        select changed_file, sum(n)::bigint as total_impacted_entities, count(*)::bigint as impacted_files, array_to_string(list(line order by file_path)[1:5], chr(10)) as listing from l group by changed_file""",
    "graph_export_json": f"""with {_GLOBAL}, deps as (select distinct {_FILE_OF.format('src')} as a, {_FILE_OF.format('dst')} as b from alledges where {_FILE_OF.format('src')} <> {_FILE_OF.format('dst')})
        select 'entities' as section, to_json({{'id': id, 'name': name, 'type': type, 'file': file_path, 'start_line': start_line, 'end_line': end_line, 'parent_class': parent_class}})::varchar as json from ent
        union all select 'calls', to_json({{'from': src, 'to': dst, 'line': line}})::varchar from edges union all select 'file_dependencies', to_json({{'from': a, 'to': b, 'type': 'call'}})::varchar from deps""",
    "impact_depth3": f"with recursive {_EDGES}, {_IMPACT} select * from imp",
    "impact_by_file": f"""with recursive {_EDGES}, {_IMPACT}, p as (select distinct {_FILE_OF.format('seed')} as changed_file, id from imp)
        select changed_file, {_FILE_OF.format('id')} as file_path, count(*)::bigint as n_entities, string_agg(distinct regexp_extract(id, '([^:]*)$', 1), ',' order by regexp_extract(id, '([^:]*)$', 1)) as names from p group by all""",
    "call_chain": f"""with recursive {_EDGES},
        pairs as (select a.start, b.goal from (select file_path, max_by(id, (seq, id)) as start from ent where id in (select src from edges) group by file_path) a
          join (select file_path, min_by(id, (seq, id)) as goal from ent where id in (select dst from edges) group by file_path) b using (file_path) where a.start <> b.goal),
        walk as (select start, goal, [start] as path, start as tip from pairs union all
          select w.start, w.goal, list_append(w.path, e.dst), e.dst from walk w join edges e on e.src = w.tip and e.src <> e.dst where w.tip <> w.goal and not list_contains(w.path, e.dst) and len(w.path) <= 10)
        select start, goal, array_to_string(path, ' -> ') as chain from walk where tip = goal""",
    "scc": f"with recursive {_EDGES}, {_REACH} select id, component from comp",
    "graph_stats": f"""with recursive {_EDGES}, {_REACH} select (select count(*) from ent)::bigint as total_entities, (select count(*) from edges)::bigint as total_calls,
        (select count(distinct file_path) from ent)::bigint as total_files, coalesce(round((select count(*) from edges)::double / nullif((select count(*) from ent), 0), 6), 0) as avg_calls,
        (select count(*) from (select component from comp group by component having count(*) > 1))::bigint as cycles""",
    "knn_entities": _KNN.format(on="true", k=5),
    "knn_filtered": _KNN.format(on="q.label = x.label", k=5),
    "knn_files": """with v as (select id, max(embedding) as e from file_vectors where id is not null group by id), u as (select * from v where len(e) = 384),
        x as (select q.id as query_id, u.id as id, list_sum(list_transform(list_zip(q.e, u.e), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as exact
          from u q, u where ('0x' || substr(q.id, 1, 8))::bigint % 20 = 0 qualify row_number() over (partition by q.id order by exact, u.id) <= 3)
        select query_id, id, round(exact, 6) as distance from x""",
    "vector_stats": "select (select count(distinct id) from entity_vectors)::bigint as total_entities, (select count(distinct id) from file_vectors)::bigint as total_files, 384 as dimension",
    "vector_upsert": f"select id, case when type = 'function' then 'v2 ' || coalesce(document, '') else document end as document, type, file_path from {_VEC}",
    "vector_delete_file": f"{_LAST} select id, file_path from {_VEC} where file_path in (select path from last)",
    "minimal_context": f"with {_EDGES}, {_NEAR}, {_CONTEXT} select id, context from parts",
    "question_contexts": f"with {_EDGES}, {_NEAR}, {_CONTEXT}, {_ASKED} select query_id, n_hits, context, (length(context) // 4)::bigint as tokens from asked",
    "token_estimate": "select id, (length(document) // 4)::bigint as tokens from (select id, max(document) as document from entity_vectors where id is not null group by id) where document is not null",
    "token_totals": f"""with {_EDGES}, {_NEAR}, {_CONTEXT}, {_ASKED},
        n as (select (coalesce(sum(n), 0) // 4)::bigint as naive from (select distinct path, length(coalesce({_TEXT}, '')) as n, len(string_split(coalesce({_TEXT}, ''), chr(10))) from files)),
        t as (select count(*)::bigint as questions, (any_value(naive) * count(*))::bigint as naive_tokens, sum(length(context) // 4)::bigint as optimized_tokens from asked, n)
        select questions, naive_tokens, optimized_tokens, naive_tokens - optimized_tokens as savings, round((naive_tokens - optimized_tokens)::double / questions, 4) as mean_savings,
        round((naive_tokens - optimized_tokens)::double * 100 / naive_tokens, 4) as savings_percentage, round((naive_tokens - optimized_tokens)::double / 1e6 * 0.150, 6) as dollars_saved from t""",
    "project_summary": f"""with recursive {_EDGES}, {_REACH} select (select count(distinct path) from files)::bigint as files, count(*)::bigint as entities, {', '.join(f"count(*) filter (type = '{t}')::bigint as n_{t}" for t in context.TYPES)},
        (select count(*) from edges)::bigint as calls, coalesce(round((select count(*) from edges)::double / nullif(count(*), 0), 6), 0) as avg_calls,
        (select count(*) from (select component from comp group by component having count(*) > 1))::bigint as cycles from ent""",
    "file_tree_top5": _TREE.format(depth=2, parent=_PARENT),
    "file_tree_depth3": _TREE.format(depth=3, parent=_PARENT),
    "language_stats": "select unnest(['c', 'go', 'java', 'javascript', 'python', 'typescript']) as language, unnest([1, 1, 1, 1, 1, 0]) as available",
}


def _filled(text) -> str:
    """SQL for a text with {k}."""
    return "null::varchar" if text is None else "'" + text.replace("{k}", "' || p_partkey || '") + "'"


def _made_entities(language: str, where: str = "true") -> str:
    ext, _, defined, _ = MADE[language]
    rows = [f"select 'made/f' || p_partkey || '.{ext}' as file_path, {_filled(name)} as name, '{kind}' as type, {a} as start_line, {b} as end_line, {_filled(parent)} as parent_class from part where {where}" for name, kind, a, b, parent in defined]
    return " union all ".join(rows)


_MADE_CALLS = [(f"'made/f' || p_partkey || '.{ext}'", _filled(caller), _filled(callee), line) for ext, _, _, (caller, callee, line) in MADE.values()]
ORACLES |= {f"parse_{x}": _made_entities(x) for x in MADE} | {
    "incremental_made": " union all ".join(_made_entities(x, "p_partkey % 5 = 0 or p_partkey % 3 = 0") for x in MADE),
    "extract_calls_made": " union all ".join(f"select {path} as file_path, {a} as caller, {b} as callee, {line} as line_number from part" for path, a, b, line in _MADE_CALLS),
    "parsed_edges": " union all ".join(f"select {path} || '::' || {a} as src, {path} || '::' || {b} as dst, {line} as line from part" for path, a, b, line in _MADE_CALLS),
}
