"""Cases in which an operator or a pipeline stage once did less than its whole job."""

import random

import pytest

import corpus_pipeline
from provena.llm import decontam, linededup, minhash
from tests.llm.test_operators import _classes, _sets, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).repartition(3)


def changed(text, places):
    words = text.split()
    for k in places:
        words[k] = f"changed{k}"
    return " ".join(words)


def test_near_dedup_stage_drops_copies_of_similarity_080(spark, sf):
    rows = [(10 * k + 1, prose(k, 200)) for k in range(40)]
    rows += [(i + 1, changed(t, (30, 70, 110, 150))) for i, t in rows]  # 0.80 to 0.85
    rows += [(i + 2, changed(t, (20, 50, 80, 110, 140, 170))) for i, t in rows[:20]]  # below 0.80
    sets = _sets(rows)
    alike = {(a, b): 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert sum(80 <= x < 85 for x in alike.values()) >= 40 and not any(x >= 85 for x in alike.values())
    want = _classes(sets, [p for p, x in alike.items() if x >= 80])
    got = corpus_pipeline.near_dedup(spark, documents(spark, rows), sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))


def test_bands_find_a_pair_at_the_threshold():
    for percent in (80, 85, 90):
        size = minhash.band_rows(percent)
        assert (1 - (percent / 100) ** size) ** (minhash._K // size) < 3e-5
        assert minhash.slack(percent) >= 4 * (percent / 100 * (1 - percent / 100) / minhash._K) ** 0.5
    assert (minhash.band_rows(85), minhash.slack(85)) == (minhash.ROWS, minhash.SLACK)


def edited(r, text, n):
    for _ in range(n):
        at = r.randrange(len(text))
        text = text[:at] + r.choice(["", "q", "é", text[at] + "w"]) + text[at + 1 :]
    return text.strip()


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d)))
    return row[-1]


@pytest.mark.parametrize("threshold", [2, 3])
def test_line_join_equals_brute_force(spark, threshold):
    r, rows = random.Random(threshold), set()
    for k in range(25):
        line = prose(k, r.choice([5, 6, 8, 15]))
        rows |= {line, *(edited(r, line, n) for n in (1, 2, 3, 4))}
    rows = list(enumerate(sorted(x for x in rows if len(x) >= 20)))
    near = {(a, b): plain_distance(x, y) for a, x in rows for b, y in rows if a < b and abs(len(x) - len(y)) <= threshold}
    for percent in (100, 10):
        want = {p for p, d in near.items() if d <= min(threshold, min(len(rows[p[0]][1]), len(rows[p[1]][1])) * percent // 100)}
        lines = linededup.measured(spark.createDataFrame(rows, "id long, line string"))
        assert {(min(x), max(x)) for x in linededup.links(lines, threshold, percent).collect()} == want and any(near[p] == threshold for p in want)


def test_line_dedup_stage_drops_lines_of_three_edits(spark, sf):
    long = prose(1, 40)
    rows = [(1, long + "\n" + prose(2, 40)), (2, prose(3, 40) + "\n" + long[:50] + "xyz" + long[53:]), (3, long[:50] + "vwxyz" + long[55:] + "\n" + prose(4, 40))]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, documents(spark, rows), sf).collect()}
    assert got == {1: rows[0][1], 2: prose(3, 40), 3: rows[2][1]}


def test_near_dedup_stage_keeps_texts_without_an_id_of_their_own(spark, sf):
    a, b, c, d = (prose(k, 100) for k in range(4))
    rows = [(None, a), (None, b), (None, None), (7, a), (7, a), (7, c), (3, d), (9, d), (9, changed(b, (50,))), (9, None), (1, b), (4, None), (4, None)]
    got = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), sf).collect()))
    assert got == sorted([(0, a), (0, b), (0, ""), (7, a), (7, c), (3, d), (9, ""), (1, b), (4, "")])


def test_short_items_are_found_exactly_on_word_boundaries(spark):
    rows = [(1, "Well: WHAT is 2 + 2? Indeed, what is 2, 2"), (2, "what is 2 22"), (3, "somewhat is 2 2"), (4, "what is 2 3"), (5, None), (6, "what is 2 2 what is 2 2"), (7, "so so so")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, "What is 2+2?"), (8, "?!"), (9, "so so")], "item_id long, text string")
    got = {r.doc_id: [(h.item_id, h.distance, rows[r.doc_id - 1][1][h.start : h.end]) for h in r.hits] for r in decontam.find_items(docs, bench).collect()}
    assert got == {1: [(7, 0, "WHAT is 2 + 2"), (7, 0, "what is 2, 2")], 2: [], 3: [], 4: [], 5: [], 6: [(7, 0, "what is 2 2")] * 2, 7: [(9, 0, "so so")]}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()) == [2, 3, 4, 5]


def test_many_blocks_keep_repeated_rows_apart(spark, monkeypatch):
    items = [prose(20 + k, 12) for k in range(3)]
    texts = [(1, f"x {items[0]} y"), (1, f"x {items[0]} y"), (1, f"{items[2]} z {items[1]}"), (None, items[0]), (None, items[1]), (None, None), (2, "clean")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (9, items[0])], "item_id long, text string")
    hits = lambda: sorted(((r.doc_id or 0, [(h.item_id, h.distance, h.start, h.end) for h in r.hits]) for r in decontam.find_items(docs, bench).collect()))
    one = hits()
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 60)
    assert len(list(decontam.blocks(bench, "item_id", "text"))) >= 3
    assert hits() == one and [[x[0] for x in h] for _, h in one] == [[], [0, 9], [1], [0, 9], [0, 9], [1, 2], []]


def test_line_dedup_stage_drops_exact_repeats_of_few_words(spark, sf):
    rows = [(1, "All rights reserved.\n" + prose(1, 30)), (2, prose(2, 30) + "\n All rights reserved. \nshort"), (3, "All rights reserved!\nshort"), (4, "All rights reserved.")]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, documents(spark, rows), sf).collect()}
    assert got == {1: rows[0][1], 2: prose(2, 30) + "\nshort", 3: rows[2][1]}


def test_lines_of_many_pieces_equal_brute_force(spark):
    r, rows = random.Random(5), set()
    for k in range(12):
        line = prose(k, r.choice([25, 40]))
        rows |= {line, line.replace(" ", "  ", 2), line[:90] + " 7" + line[90:], *(edited(r, line, n) for n in (1, 2, 3, 3, 4))}
    rows = list(enumerate(sorted(rows)))
    near = {(a, b): plain_distance(x, y) for a, x in rows for b, y in rows if a < b and abs(len(x) - len(y)) <= 3 and x[:12] == y[:12] or a < b and x[-12:] == y[-12:]}
    lines = linededup.measured(spark.createDataFrame(rows, "id long, line string"))
    assert lines.where(f"pieces >= {2 * linededup.THRESHOLD + 1}").count() > 90
    got = {(min(x), max(x)) for x in linededup.links(lines).collect()}
    assert got >= {p for p, d in near.items() if d <= 3} and all(plain_distance(rows[a][1], rows[b][1]) <= 3 for a, b in got)


def test_many_variants_of_a_line_make_few_pairs(spark, monkeypatch):
    line, made = prose(3, 40), []
    variants = [line, *(line[:k] + "xyz" + line[k:] for k in range(5, 125))]
    docs = spark.createDataFrame([*enumerate(variants), (200, line), (201, prose(4, 40))], "doc_id long, text string")
    plain = linededup.confirmed
    monkeypatch.setattr(linededup, "confirmed", lambda pairs, *more: (made.append(pairs.count()), plain(pairs, *more))[1])
    got = {x.doc_id: x.drops for x in linededup.repeated(docs).collect()}
    assert got == {k: [0] for k in (*range(1, 121), 200)} and sum(made) < 2 * len(variants)
