import random

from arbor.llm.glyphs import LOOKALIKES, of
from arbor.llm.leaks import BlockMaxIndex, Bounds, leak_report, leaks, parts, words

KNOWN = of(tuple(tuple(c for c in row if c) for row in LOOKALIKES))

WORDS = [f"w{i}" for i in range(60)]


def _brute(docs, items, run=15):
    grams = [(i, {tuple(w[p:p + run]) for p in range(len(w) - run + 1)}) for i, t in items if t for w in [words(t, KNOWN)]]
    out = set()
    for d, text in docs:
        w = words(text or "", KNOWN)
        own = {tuple(w[p:p + run]) for p in range(len(w) - run + 1)}
        out |= {(d, i) for i, g in grams if own & g}
    return out


def _case(seed):
    rng = random.Random(seed)
    items = [(100 + k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(10, 40)))) for k in range(25)]
    docs = []
    for d in range(60):
        text = [rng.choice(WORDS) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            _, item = rng.choice(items)
            w = item.split()
            s = rng.randrange(len(w))
            at = rng.randint(0, len(text))
            text[at:at] = w[s:s + rng.choice((13, 14, 15, 16, 30))]
        docs.append((d, " ".join(text)))
    return docs, items


def _found(index, texts):
    bounds = Bounds(KNOWN, index.run)
    bounds.add(index)
    bounds.seal()
    return [index.leaks(bounds.stretches(t)) for t in texts]


def test_index_equals_brute_force():
    for seed in range(8):
        docs, items = _case(seed)
        index = BlockMaxIndex(items, KNOWN)
        got = {(d, index.item_ids[k]) for (d, _), found in zip(docs, _found(index, [t for _, t in docs])) for k in found}
        assert got == _brute(docs, items)


def test_wand_retrieves_what_scoring_every_item_retrieves(monkeypatch):
    from arbor.llm import leaks as module

    for seed, blocks in enumerate((1, 2, 5, 9, 40, 50)):
        docs, items = _case(seed)
        monkeypatch.setattr(module, "BLOCKS", blocks)
        index = BlockMaxIndex(items, KNOWN)
        for _, text in docs:
            ids = index.numbers(text.split())
            for lo in range(0, max(1, len(ids) - 14), 15):
                terms = sorted({t for t in ids[lo:lo + 29] if t})
                score = dict.fromkeys(range(len(index.ids)), 0.0)
                for t in terms:
                    for k, s in zip(index.items[t], index.impacts[t]):
                        score[k] += s
                got = index.retrieve(terms, range(blocks))
                assert got == sorted(got) and {k for k, s in score.items() if s >= 1 + 1e-6} <= set(got) <= {k for k, s in score.items() if s >= 1 - 1e-6}


def test_report_counts_question_and_answers(spark):
    story = "On day nine the owner of a mill paid 22 crowns to a miller who never came back again"
    ask, options = "Which remedy is open to the miller in this place after so many years", "(a) lapse for want of form; (b) priority of the pledge made by the brother of the owner of it"
    item = f"{story}. {ask}: {options}?"
    assert parts(item) == (19, 33) and parts(f"{story}. {ask}? Yes") == (19, 34) and parts(story) == (19, 19)
    docs = spark.createDataFrame([(1, f"Before. {item} After."), (2, f"x {story} y"), (3, f"{ask} {options}"), (4, f"{story} z {options}")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[2:] for r in leak_report(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    size, tail = len(words(item, KNOWN)), len(words(options, KNOWN))
    assert got == {1: (size, size, size, 14, tail), 2: (19, size, 19, 0, 0), 3: (14 + tail, size, 14 + tail, 14, tail), 4: (20, size, 19 + tail, 0, tail)}


def test_layout_case_and_hidden_characters_dont_matter(spark, rows):
    passage = "On day nine the Café owner paid 22 crowns to a miller who never came back again at all"
    changed = passage.upper().replace(" ", " -\n ", 3).replace("O", "О").replace("PAID", "PA\u200bID").replace("É", "E\u0301")
    data = [(1, changed), (2, passage.replace("Café", "Cafe")), (3, None), (4, ""), (5, passage[:30]), (1, changed), (6, "x " * 50_000 + passage), (None, passage), (7, passage.replace("paid", "then paid"))]
    docs = spark.createDataFrame([(i, t, 5) for i, t in data], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, passage, 1), (11, passage, 1), (12, "too short", 1), (13, None, 1), (10, passage, 1)], "item_id long, text string, doc_id int")
    assert rows(leaks(docs, items)) == [(1, 10), (1, 11), (6, 10), (6, 11)]
    assert rows(leaks(docs, items.limit(0))) == [] and rows(leaks(docs.limit(0), items)) == []


def test_shards(spark, rows, monkeypatch):
    from arbor.llm import leaks as module

    docs, items = _case(99)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(module, "SHARD_WORDS", 200)
    assert set(rows(leaks(d, i))) == _brute(docs, items)


def test_english_passage_in_a_bulgarian_text(spark, rows):
    passage = "That is a test to see that THE court at a yet later date has to take a note"
    around = "Съдът реши, че жалбата е допустима и я разглежда по същество. " * 5
    swapped = passage.translate(str.maketrans("aeopcTHE", "аеорсТНЕ"))
    data = [(1, around + passage + " " + around), (2, around + passage.upper() + " " + around), (3, around + swapped + " " + around), (4, around + swapped.upper()), (5, passage.upper()), (6, around), (7, around + passage.replace("note", "vote").replace("see", "be"))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    items = spark.createDataFrame([(10, passage), (11, passage.upper()), (12, around[:300])], "item_id long, text string")
    assert rows(leaks(docs, items)) == sorted([(d, i) for d in (1, 2, 3, 4, 5) for i in (10, 11)] + [(d, 12) for d in (1, 2, 3, 4, 6, 7)], key=lambda r: tuple(map(str, r)))


def test_case_and_look_alikes_meet_but_other_letters_dont():
    greek = "ΝΑ ΕΙΝΑΙ ΚΑΛΟ ΤΟ ΝΕΡΟ ΤΗΣ ΠΗΓΗΣ ΚΑΙ Η ΝΥΧΤΑ ΣΤΟ ΒΟΥΝΟ ΕΙΝΑΙ ΚΡΥΑ ΚΑΙ ΝΕΑ"
    latin = "now the vest is by the door and no one can say if we may go in yet"
    belarusian = "У лесе жыў воўк і быў ён шэры а воўк быў зноў каля ракі ў полі"
    index = BlockMaxIndex([(1, greek.lower()), (2, latin), (3, belarusian)], KNOWN)
    texts = [greek, latin.upper().replace("N", "Ν").replace("Y", "Υ"), latin.replace("now", "vow").replace("vest", "nest").replace("may", "mau").replace("by", "bu").replace("no ", "vo "), belarusian.replace("ў", "y̆"), belarusian.upper()]
    assert [set(x) for x in _found(index, texts)] == [{0}, {1}, set(), {2}, {2}]
