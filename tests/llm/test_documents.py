"""Language, near copies, leaks, licences, shards: against brute force or planted cases."""

import random
import re

from pyspark.sql import functions as F

from periscan.llm import decontaminate, language, licenses, near, shards, shingles
from periscan.llm.components import connected_components
from periscan.session import table

R = random.Random(3)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(3, 8))) for _ in range(900)]


def text(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_held_out_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.fold() != 2))
    held = language.identify(docs, model).where(language.fold() == 2)
    assert held.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.9


def test_texts_without_letters_are_und(spark):
    model = language.Model({"aa": b"abcdef ghijkl mnopab " * 9, "bb": b"xyzuvw stuvxy zyxwvu " * 9})
    rows = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !!", 1), (4, "abcdef ghijkl mnopab", 1), (5, "xyzuvw stuvxy zyxwvu " * 6000, 1), (6, "x\u00b2 \u00bd"[1:], 1)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in language.identify(rows, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 6)] == ["und", "und", "und", "aa", "bb", "und"]
    assert not got[1].accepted and all(0 <= r.score <= 1 for r in got.values())
    nothing = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language.identify(rows, nothing).where("lang_pred <> 'und'").count() == 0


def brute_groups(rows, width):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_copies_equal_brute_force(spark):
    rows = [(k, text(R.randint(1, 80))) for k in range(60)]
    base = text(150)
    for k in range(100, 160):  # a chain and a star of edits around the threshold
        w = (base if k % 2 else rows[-1][1]).split()
        for _ in range(R.randint(0, 6)):
            w[R.randrange(len(w))] = R.choice(WORDS)
        rows.append((k, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "One"), (204, "oNE"), (205, "É"), (206, "é"), (207, base.upper())]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int").repartition(3)
    for width in (2, 5):
        want = brute_groups(rows, width)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, width=width).collect()}
        assert got == want


def test_near_copies_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(none).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((str(r.component_id), r.kept) for r in near.near_duplicates(nulls).collect()) == [("1", True), ("None", False), ("None", False)]


def test_rows_of_one_id_are_one_document(spark):
    rows = [(3, "a b c"), (5, "a b c"), (5, "x y z"), (9, "x y z"), (9, "x y z"), (11, "p q"), (11, "r s"), (2, "r s"), (12, "p q")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (9, 3, False), (11, 2, False), (11, 2, False), (2, 2, True), (12, 2, False)])


def test_every_set_of_an_id_is_compared(spark):
    r = random.Random(8)
    one, other = text(60, r), text(60, r)
    edit = lambda t: t + " more"
    rows = [(1, one), (1, other), (2, edit(one)), (3, edit(other)), (4, text(60, r))]
    got = {x.doc_id: x.component_id for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_very_long_texts_and_words(spark):
    r = random.Random(9)
    long = text(300_000, r)
    rows = [(1, long), (2, long + " end"), (3, "w" * 2_000_000), (4, "w" * 2_000_000), (5, text(5, r))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k][1] for k in range(1, 6)] == [1, 1, 3, 3, 5] and got[2][0] == got[1][0] + 1 and got[3][0] == 1


def test_words_of_even_patterns_differ(spark):
    """Hashes modulo a power of two give the Thue-Morse word and its opposite one value, whatever their base."""
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    pairs = [["".join("ab"[b ^ flip] for b in bits[:n]) for flip in (0, 1)] for n in (1024, 4096)]
    rows = [(10 * k + flip, word) for k, pair in enumerate(pairs) for flip, word in enumerate(pair)] + [(5, pairs[0][0].upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 5: (1, 0), 10: (1, 10), 11: (1, 11)}


def test_words_across_segments(monkeypatch):
    monkeypatch.setattr(shingles, "SEGMENT", 64)
    monkeypatch.setattr(shingles, "POWERS", [(p, b, shingles._powers(b, p), shingles._powers(pow(b, -1, p), p)) for p, b in shingles.FIELDS])
    texts = ["x" * n + " é one\ttwo" for n in (0, 1, 60, 63, 64, 65, 200)] + [None, "", " \n", "one"]
    hashes, counts = shingles.word_hashes(texts)
    words = [w for t in texts for w in (t or "").split()]
    assert counts.tolist() == [len((t or "").split()) for t in texts] and len({*zip(words, hashes.tolist(), strict=True)}) == len({*words}) == len({*hashes.tolist()})


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 130)} == {100}


QUESTION = "Tom bought 12 apples and 7 pears at the market then Tom gave 12 apples to his sister who lives 5 km away near the old mill"


def leaks(spark, texts, items=((1, QUESTION),)):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame(list(items), "item_id long, text string"))
    return {r.doc_id: (r.item_id, r.kind) for r in found.collect()}


def test_leaks_verbatim_and_with_other_parameters(spark):
    other = QUESTION.replace("Tom", "Maria").replace("12", "1,250").replace("7", "3.5").replace("5 km", "9 miles")
    mixed = QUESTION.replace("Tom bought", "Ann bought").replace("Tom gave", "Bob gave").replace("12 apples and", "3 apples and")
    got = leaks(spark, [f"{text(30)} {QUESTION} {text(30)}", f"{text(9)}\n{other}.", text(200), None, "", mixed, f"{other} {other}", QUESTION])
    assert got == {0: (1, "exact"), 1: (1, "reparameterised"), 6: (1, "reparameterised"), 7: (1, "exact")}


def test_slots_are_held_against_the_whole_occurrence(spark):
    mixed = QUESTION.replace("Tom bought", "Ann bought").replace("Tom gave", "Bob gave").replace("12 apples and", "3 apples and")
    one_word_more = mixed.replace("market then", "market and then")
    same_value = QUESTION.replace("Tom", "Maria").replace("12", "7").replace("5 km", "7 km")
    chance = "she said Tom paid 3 and 4 the bill for lunch and left"
    item = "Eva and 3 friends of Max paid the bill for lunch at 12 in Paris with 40 euros and 2 coins"
    assert leaks(spark, [mixed, one_word_more, same_value]) == {}
    assert leaks(spark, [chance, "we and 5 others paid the bill for lunch today"], [(1, item)]) == {}
    inserted = QUESTION.replace("Tom", "Maria").replace("12", "15").replace("market then", "market and then")
    assert leaks(spark, [inserted, QUESTION.replace("market then", "market and then")]) == {0: (1, "reparameterised"), 1: (1, "exact")}


def test_leaks_of_empty_tables_repeated_rows_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.find_leaks(empty, spark.createDataFrame([(1, QUESTION)], "item_id long, text string")).count() == 0
    assert leaks(spark, ["a b c"], [(None, None)]) == {}
    long = text(60_000)
    docs = spark.createDataFrame([(1, f"{long} {QUESTION} {long}"), (2, QUESTION), (2, QUESTION), (3, long)], "doc_id long, text string")
    items = spark.createDataFrame([(1, QUESTION), (1, QUESTION)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.share, r.kind) for r in got) == [(1, 1.0, "exact"), (2, 1.0, "exact")]


def test_leaks_of_short_and_wordless_items(spark):
    items = [(1, "only five words are here"), (2, "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota"), (3, None), (4, ""), (None, "null id item text with words")]
    got = leaks(spark, ["well only five words are here indeed", "so Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota ends", "Kappa Lambda My Ny Xi Omikron Pi Rho Sigma", "null id item text with words"], items)
    assert got == {0: (1, "exact"), 1: (2, "exact")}
    assert leaks(spark, ["a"], [(3, None)]) == {}


def test_short_items_in_long_texts(spark):
    """Time and memory follow the text's length: whole words travel with none of its windows."""
    items = ((1, "What is 12 plus 15?"), (2, "Where was Anna born then?"), (3, "12 km"), (4, "Ann Bob Cid Dan Eve Fay Gus saw Hal Ida Joe met Kim Leo Max Ned"))
    long = text(25_000)
    ends = ["What is 3 plus 4", "Where was Paul born then", "long 9 km", "Una Vic Wes Xia Yan Zoe Abe saw Bea Cal Deb met Eli Fox Gil Hob"]
    got = leaks(spark, [f"{long} {x} {long}" for x in ["", *ends]] + ["7 km", "km 12"], items)
    assert {k: i for k, (i, _) in got.items()} == {1: 1, 2: 2, 4: 4}


def test_leaks_in_any_case_and_of_short_runs(spark):
    words = QUESTION.split()
    passages = [" ".join(words[3:21]), " ".join(words[3:16]), " ".join(words[3:15])]  # 18, 13 and 12 words
    got = leaks(spark, [QUESTION.upper(), QUESTION.title(), QUESTION.lower(), *(f"{text(30)} {p} {text(30)}" for p in passages)])
    assert {k: v for k, v in got.items()} == {k: (1, "exact") for k in range(5)}


def test_leaks_of_short_questions_with_other_numbers(spark):
    items = [(1, "What is 12 plus 15?"), (2, "How many is 7 times 9?"), (3, "Anna Berg of Oslo"), (4, "Add 4 and 4")]
    texts = ["so What is 3 plus 44 then", "How many is 6 times 8?", "what is 12 PLUS 15", "Olaf Lund of Bergen", "Add 5 and 6", "Add 5 and 5", "What is 3 minus 44"]
    assert leaks(spark, texts, items) == {0: (1, "reparameterised"), 1: (2, "reparameterised"), 2: (1, "exact"), 5: (4, "reparameterised")}


def test_licenses_and_inheritance(spark):
    files = [
        (1, "/p/LICENSE", "Released under the MIT License.\nmore"),
        (2, "/p/src/a/x.c", "int main"),
        (3, "/p/src/a/y.c", "x\nLicensed under the Apache License, Version 2.0.\ny"),
        (4, "/q/z.c", "nothing about it"),
        (5, None, None),
        (6, "/p/src/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (7, "/p/w.c", "we have no permission to say"),
    ]
    got = {r.id: (r.license, r.origin, r.from_dir) for r in licenses.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "own", None),
        2: ("GPL-3.0", "inherited", "/p/src"),
        3: ("Apache-2.0", "own", None),
        4: (None, "none", None),
        5: (None, "none", None),
        6: ("GPL-3.0", "own", None),
        7: ("MIT", "inherited", "/p"),
    }


def test_licenses_by_version_in_wrapped_headers_and_whole_files(spark):
    gpl = "/* This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version. */\nint main() {\n}"
    lgpl = gpl.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1")
    whole = dict(licenses.TEMPLATES)  # the last of each licence is its whole text
    bsd = [t for k, t in licenses.TEMPLATES if k.startswith("BSD") and "DAMAGE" in t]
    files = [gpl, lgpl, gpl.replace("\n * ", " "), whole["GPL-2.0"], whole["LGPL-2.1"], whole["GPL-3.0"], bsd[0].replace("are met:", "are met:\n"), bsd[1].replace("are met:", "are met:\n"), "GNU GENERAL PUBLIC LICENSE", "x\n# SPDX-License-Identifier: GPL-2.0-or-later\ny", whole["ISC"]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(files)], "id long, text string")
    got = {r.id: r.license for r in licenses.declared(df).collect()}
    assert [got.get(k) for k in range(len(files))] == ["GPL-2.0", "LGPL-2.1", "GPL-2.0", "GPL-2.0", "LGPL-2.1", "GPL-3.0", "BSD-2-Clause", "BSD-3-Clause", None, "GPL-2.0", "ISC"]


def test_licenses_of_no_files_and_clashing_columns(spark):
    schema = "id long, path string, text string, license string, score double, line int, h long"
    rows = [(1, "/a/LICENSE", "SPDX-License-Identifier: MIT", "x", 1.0, 1, 1), (2, "/a/b/c.py", None, "y", 2.0, 2, 2), (3, None, "", "z", 3.0, 3, 3)]
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0
    got = {r.id: r.license for r in licenses.scan(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == "MIT" and got[2] == "MIT" and set(got) == {1, 2, 3}


def test_shards_are_exact_gapless_and_uniform(spark):
    df = spark.range(5003).select(F.col("id").alias("doc_id"), F.lit(1).alias("shard"))
    rows = shards.shuffle_into_shards(df, 8, seed=1).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append((r.slot, r.doc_id))
    assert sorted(len(x) for x in by.values()) == [625] * 5 + [626] * 3
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in by.values()) and len({r.doc_id for r in rows}) == 5003
    low = [sum(d < 2500 for _, d in x) for x in by.values()]  # hypergeometric with deviation 12
    assert all(abs(n - 312) < 60 for n in low)
    mean = [sum(d for _, d in x[:300]) / 300 for x in (sorted(v) for v in by.values())]
    assert all(abs(m - 2501) < 420 for m in mean)


def test_matrix_has_the_law(spark):
    counts = spark.createDataFrame([(k, 40) for k in range(8)], "block long, n long")
    cells = []
    for seed in range(12):
        rows = shards.communication_matrix(counts, 3, 4, seed).collect()
        assert all(sum(r.cap) == 40 for r in rows) and [sum(c) for c in zip(*(r.cap for r in rows))] == [80] * 4
        cells += [c for r in rows for c in r.cap]
    variance = sum((c - 10) ** 2 for c in cells) / len(cells)
    assert 4.5 < variance < 8.8  # 40 * 1/4 * 3/4 * 280/319 = 6.58


def test_shards_of_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(None, None)] * 30 + [(1, "a")] * 3, "doc_id long, text string")
    got = shards.shuffle_into_shards(df, 8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [4] * 7 + [5]
    assert shards.shuffle_into_shards(df.limit(0), 8).count() == 0


def test_whole_documents_go_to_the_shards(spark, sf_dir, monkeypatch):
    import zlib

    from periscan.llm.queries import op2_hypergeometric_shards

    got = {}

    def kept(df, *args, call=shards.shuffle_into_shards, **more):
        got["columns"], got["rows"] = df.columns, call(df, *args, **more)
        return got["rows"]

    monkeypatch.setattr(shards, "shuffle_into_shards", kept)
    rows = op2_hypergeometric_shards(spark, sf_dir).collect()
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    assert got["columns"] == table(spark, sf_dir, "documents").columns
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items())


def test_first_shuffle_of_shards_is_gone_when_the_second_begins(spark, monkeypatch):
    """Not left to the driver's garbage collection."""
    from periscan.llm import shards

    left = []
    old = shards.materialize

    def seen(df, name, **kept):
        out = old(df, name, **kept)
        if name == "sent":
            # The shuffle that carried the texts has the largest id; its files are named after it.
            found = [str(f) for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f]
            newest = max((int(f.split("shuffle_")[1].split("_")[0]) for f in found), default=-1)
            left.append((newest, mark[0]))
        elif name == "matrix":
            found = [str(f) for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f]
            mark[0] = max((int(f.split("shuffle_")[1].split("_")[0]) for f in found), default=-1)
        return out

    mark = [-1]
    monkeypatch.setattr(shards, "materialize", seen)
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    rows = shards.shuffle_into_shards(df, 8, seed=3).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("slots")).collect()
    assert [(r.n, r.top + 1, r.slots) for r in rows] == [(625, 625, 625)] * 8
    assert left and all(newest <= before for newest, before in left)
