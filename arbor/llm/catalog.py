"""Registered queries of the training-data operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..plans import catalog as core
from ..sources.tables import table
from . import chunking, glyphs, handwritten, leaks, neighbours, parsing, tokenize, visual


def _made_report(s, d):
    """Sources made from parts, and broken in each way: which of them parse."""
    files = core.made_files(table(s, d, "part"))
    rows = parsing.broken(files).withColumn("repo", F.lit("made"))
    return parsing.parse_report(rows).select("path", "accepted")


QUERIES = {
    "p2_found": lambda s, d: handwritten.scored(table(s, d, "files")).where("flagged").select("path"),
    "p2_validation": lambda s, d: handwritten.validation(table(s, d, "files")),
    "p2_planted": lambda s, d: handwritten.planted(table(s, d, "files")),
    "p3_found": lambda s, d: parsing.invalid_files(table(s, d, "files")),
    "p3_report": lambda s, d: parsing.parse_report(table(s, d, "files")),
    "p3_rates": lambda s, d: parsing.rates(table(s, d, "files")),
    "p3_made": _made_report,
    "p4_found": lambda s, d: chunking.oversized_ids(table(s, d, "file_vectors"), table(s, d, "entities"), table(s, d, "files")),
    "p4_pieces": lambda s, d: chunking.oversized_pieces(table(s, d, "file_vectors"), table(s, d, "entities"), table(s, d, "files")),
    "p4_round_trip": lambda s, d: chunking.round_trip(table(s, d, "file_vectors"), table(s, d, "entities"), table(s, d, "files")),
    "p5_found": lambda s, d: neighbours.similar_pairs(table(s, d, "entity_vectors")),
    "p5_nearest": lambda s, d: neighbours.nearest(table(s, d, "entity_vectors")),
    "p5_recall": lambda s, d: neighbours.recall(table(s, d, "entity_vectors")).select("k", "queries", "reached"),
    "p7_ids": lambda s, d: tokenize.token_ids(table(s, d, "documents")),
    "p7_round_trip": lambda s, d: tokenize.decoded(tokenize.token_ids(table(s, d, "documents"))).select("doc_id", "text_md5"),
    "p8_found": lambda s, d: leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
    "p8_report": lambda s, d: leaks.leak_report(table(s, d, "documents"), table(s, d, "eval_items")),
    "p9_found": lambda s, d: visual.visual_pairs(table(s, d, "documents")),
    "p9_classes": lambda s, d: visual.visual_classes(table(s, d, "documents")),
    "p9_normalized": lambda s, d: visual.normalized(table(s, d, "documents")),
}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _folded(column: str) -> str:
    """SQL for a text with every look-alike of LOOKALIKES as the first of its row, without unseen characters."""
    first = {c: next(x for x in row if x) for row in glyphs.LOOKALIKES for c in row if c}
    single = {c: first.get(p, p) for c, p in ((chr(c), p) for c, p in glyphs._PLAIN.items()) if len(p) == 1} | {c: x for c, x in first.items() if c != x}
    for ch in map(chr, range(0x370, 0x530)):  # letters that hold their mark
        base, marks = (apart := unicodedata.normalize("NFD", ch))[0], apart[1:]
        if marks and base in first and len(made := unicodedata.normalize("NFC", first[base] + marks)) == 1:
            single[ch] = made
    unseen = "".join(f"\\x{{{c:x}}}" for c, p in glyphs._PLAIN.items() if not p)
    out = f"regexp_replace({column}, '[{unseen}]', '', 'g')"
    for ch in ("…", *map(chr, range(0xFB00, 0xFB07))):
        out = f"replace({out}, {_literal(ch)}, {_literal(glyphs._PLAIN[ord(ch)])})"
    return f"nfc_normalize(translate({out}, {_literal(''.join(single))}, {_literal(''.join(single.values()))}))"


_FORMS = f"t as (select doc_id, text, {_folded('text')} as form from documents where text is not null and doc_id is not null), f as (select distinct * from t where regexp_matches(form, '\\S'))"
_RUNS = "select distinct {id}, array_to_string(w[p:p + 14], ' ') as run from (select {id}, w, unnest(range(1, len(w) - 13)) as p from (select {id}, regexp_extract_all(lower({form}), '[\\p{{L}}\\p{{N}}]+') as w from {table} where {id} is not null and text is not null) where len(w) >= 15)"
_USABLE = "(select id from entity_vectors where len(embedding) = 384 and id is not null and list_sum(list_transform(embedding, lambda x: abs(x))) > 0 group by id)"
ORACLES: dict[str, str] = {
    "p4_found": """
with docs as (select distinct 'file' as item_kind, id as item_id from file_vectors where length(document) > 3000 and id is not null),
f as (select path, max(string_split(decode(content), chr(10))) as lines from files where content is not null group by path),
spans as (select distinct id, file_path, greatest(start_line, 1) as s, end_line as e from entities where id is not null and start_line <= end_line)
select * from docs union all
select distinct 'entity', id from spans join f on path = file_path where length(array_to_string(lines[s:e], chr(10))) > 3000""",
    "p5_found": """
with v as (select id, max(embedding) as e from entity_vectors where len(embedding) = 384 and id is not null and list_sum(list_transform(embedding, x -> abs(x))) > 0 group by id),
p as (select a.id as a, b.id as b, list_cosine_similarity(a.e, b.e) as c from v a join v b on a.id <> b.id),
k as (select a, b, c from p qualify row_number() over (partition by a order by c desc, b) <= 5)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from k where c >= 0.90""".replace("x -> abs(x)", "lambda x: abs(x)"),
    "p5_recall": f"select 5 as k, count(*)::bigint as queries, true as reached from {_USABLE} where ('0x' || substr(md5(id), 1, 8))::bigint % 20 = 0",
    "p8_found": f"""
with d as ({_RUNS.format(id='doc_id', form=_folded('text'), table='documents')}), i as ({_RUNS.format(id='item_id', form=_folded('text'), table='eval_items')})
select distinct doc_id, item_id from d join i using (run)""",
    "p9_found": f"with {_FORMS} select distinct a.doc_id as doc_a, b.doc_id as doc_b from f a join f b on a.form = b.form and a.text <> b.text and a.doc_id < b.doc_id",
    "p9_classes": f"""
with {_FORMS}, c as (select form, min(doc_id) as class_id, count(distinct text)::bigint as n_spellings from f group by form having count(distinct text) > 1)
select doc_id, class_id, n_spellings from f join c using (form)""",
    "p3_made": " union all ".join(f"select '{way}/made/f' || p_partkey || '.{ext}{('.py.js' if ext == 'py' else '.x.py') if way == 'extension' else ''}' as path, {str(way == 'whole').lower()} as accepted from part"
                                  for way in parsing.BROKEN for ext, *_ in core.MADE.values()),
    "p4_round_trip": """
with f as (select path, max(string_split(decode(content), chr(10))) as lines from files where content is not null group by path),
t as (select 'file' as item_kind, id as item_id, document as text from file_vectors where id is not null union all
  select 'entity', id, array_to_string(lines[greatest(start_line, 1):end_line], chr(10)) from entities join f on path = file_path where id is not null and start_line <= end_line)
select distinct item_kind, item_id, length(text)::bigint as n_chars, md5(text) as text_md5, true as fits, true as overlaps from t where length(text) > 3000""",
    "p7_round_trip": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
}
