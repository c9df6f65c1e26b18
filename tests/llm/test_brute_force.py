"""Registered queries against plain loops over the smoke tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import regex
import zstandard

from periscan.llm import decontaminate as d
from periscan.llm import language
from periscan.llm import licenses as lic
from periscan.llm.queries import ORACLES, QUERIES


def rows_of(sf_dir, name, columns):
    return duckdb.sql(f"select {columns} from '{sf_dir}/{name}.parquet'").fetchall()


def parsed(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", re.sub(r"(?<=[0-9])[.,:/](?=[0-9])", "", text or "")) if w]
    number = [w[0] in "0123456789" for w in words]
    template = []
    for k, w in enumerate(words):
        unit = k > 0 and number[k - 1] and w in d.UNITS
        template.append(d.NUM if number[k] else d.NAME if w[0] != w[0].lower() else d.UNIT if unit else w)
    return words, template


def covered(places):
    return len({k for at, width in places for k in range(at, at + width)})


def steady_share(pairs, key):
    of = defaultdict(list)
    for pair, n in pairs.items():
        of[pair[key]].append(n)
    return sum(max(n) >= d.MIN_CONSISTENT * sum(n) for n in of.values()) / len(of)


def leak(doc, item):
    """(windows, of, share, kind) of one document and one item, or None."""
    (dw, dt), (w, t) = doc, item
    n, width = len(w), min(len(w), d.WINDOW)
    windows = range(n - width + 1)
    strong = [a for a in windows if sum(not c.startswith("<") for c in t[a : a + width]) >= min(d.MIN_LITERALS, width)]
    said = sum(not c.startswith("<") for c in t)
    spots = range(len(dw) - width + 1)
    by_template, by_words = defaultdict(list), defaultdict(list)
    for p in spots:
        by_template[tuple(dt[p : p + width])].append(p)
        by_words[tuple(x.lower() for x in dw[p : p + width])].append(p)
    typed = [(p, a, width) for a in strong for p in by_template.get(tuple(t[a : a + width]), [])]
    if covered((a, width) for a in strong) < d.MIN_SHARE * n and (said >= 2 or (said >= 1 and t.count(d.NUM) >= 2)):
        typed += [(p, 0, n) for p in range(len(dw) - n + 1) if dt[p : p + n] == t]
    worded = {(p - a, a) for a in windows for p in by_words.get(tuple(x.lower() for x in w[a : a + width]), [])}

    strength = Counter(p - a for p, a, _ in typed)
    occurrence, last = {}, None
    for g in sorted(strength):
        occurrence[g] = 0 if last is None else occurrence[last] + (g - last >= d.WINDOW)
        last = g
    consistent, same = {}, {}
    for o in set(occurrence.values()):
        told = {}
        for p, a, size in typed:
            if occurrence[p - a] == o:
                for k in range(size):
                    if t[a + k].startswith("<"):
                        told[a + k] = max(told.get(a + k, ((0, -math.inf), "")), ((strength[p - a], p - a), dw[p + k]))
        pairs = Counter((w[slot], other) for slot, (_, other) in told.items())
        if pairs:
            consistent[o] = min(steady_share(pairs, 0), steady_share(pairs, 1))
            same[o] = all(max((n, other) for (v, other), n in pairs.items() if v == value)[1] == value for value, _ in pairs)
    good = [(p, a, size) for p, a, size in typed if consistent.get(occurrence[p - a], 1.0) >= d.MIN_CONSISTENT]
    if good:
        share = covered((a, size) for _, a, size in good) / n
        found = {a for _, a, _ in good}
        if share >= d.MIN_SHARE or len(found) >= d.MIN_WINDOWS:
            exact = all(any(same.get(occurrence[p - a], True) for p, b, _ in good if b == a) for a in found)
            return len(found), n - max(size for _, _, size in good) + 1, round(share, 6), "exact" if exact else "reparameterised"
    mixed = {g for g, o in occurrence.items() if consistent.get(o, 1.0) < d.MIN_CONSISTENT}
    ran = False
    for g, a in worded:
        long = 1
        while (g, a + long) in worded:
            long += 1
        ran |= long >= (d.MIN_WINDOWS if g in mixed else d.MIN_RUN - d.WINDOW + 1)
    clear = covered((a, width) for g, a in worded if g not in mixed)
    if ran or (worded and clear / n >= d.MIN_SHARE):
        found = {a for _, a in worded}
        return len(found), n - width + 1, round(covered((a, width) for a in found) / n, 6), "exact"
    return None


def test_leaks_of_the_smoke_tables(spark, sf_dir):
    docs = [(i, parsed(text)) for i, text in rows_of(sf_dir, "documents", "doc_id, text")]
    items = [(i, parsed(text)) for i, text in rows_of(sf_dir, "benchmark", "item_id, text")]
    want = {(i, j): found for i, doc in docs for j, item in items if (found := leak(doc, item))}
    got = {(r["doc_id"], r["item_id"]): (r["windows"], r["of"], r["share"], r["kind"]) for r in QUERIES["op6_decontamination"](spark, sf_dir).collect()}
    assert want and got == want


def vector(text, idf, other):
    counts = Counter(x for x in re.split("[^a-z0-9]+", text.lower()) if x)
    raw = {x: n * idf.get(x, other) for x, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {x: v / norm for x, v in raw.items()}


def best_licenses(texts):
    """{id: (score, line, license)} of the files that declare a licence."""
    vocabulary = {x for _, text in lic.TEMPLATES for x in re.findall("[a-z0-9]+", text.lower())}
    df = Counter(x for text in texts.values() for x in vocabulary & set(re.split("[^a-z0-9]+", (text or "").lower())))
    other = math.log(1 + len(texts)) + 1
    idf = {x: math.log((1 + len(texts)) / (1 + df[x])) + 1 for x in vocabulary}
    templates = [(name, vector(text, idf, other)) for name, text in lic.TEMPLATES]

    def best(unit):
        if "\n" not in unit and (m := re.search(lic.SPDX, unit, re.ASCII)):
            return 1.0, re.sub(r"(?i)(-only|-or-later|\+)$", "", m[1])
        v = vector(unit, idf, other)
        scored = [(-round(sum(x * t.get(k, 0.0) for k, x in v.items()), 6), name) for name, t in templates]
        told = [(s, name) for s, name in scored if -s >= lic.MIN_COSINE and (name not in lic.NEEDS or re.search(lic.NEEDS[name], unit.lower(), re.ASCII))]
        return (-min(told)[0], min(told)[1]) if told else None

    found = {}
    for i, text in texts.items():
        if not text or not re.search(lic.ANCHORS, text, re.ASCII):
            continue
        lines = text.split("\n")
        units = {(k, x) for k, x in enumerate(lines) if re.search(lic.ANCHORS, x, re.ASCII)} | {(-1, text)}
        for k, x in enumerate(lines):
            if re.search(lic.ANCHORS, x, re.ASCII) and len(x) <= lic.WRAPPED:
                for start in {k, max(k - 1, 0)}:
                    for size in lic.BLOCK_LINES:
                        some = lines[start : start + size]
                        if len(some) > 1 and all(len(y) <= lic.WRAPPED for y in some):
                            units.add((start, "\n".join(some)))
        third = re.search(lic.THIRD_CLAUSE, text, re.ASCII)
        told = [(-b[0], k, "BSD-3-Clause" if third and b[1] == "BSD-2-Clause" else b[1]) for k, x in units if (b := best(x))]
        if told:
            score, line, name = min(told)
            found[i] = (-score, line, name)
    return found


def test_licenses_of_the_smoke_tables(spark, sf_dir):
    rows = rows_of(sf_dir, "documents", "doc_id, text, source")
    own = best_licenses({i: text for i, text, _ in rows})
    folder = {}
    for i, _, source in rows:
        inner = [] if i % 100 == 0 else [str(i // 10_000)] if i % 10 == 0 else [str(i // 10_000), str(i // 500)]
        folder[i] = ["", source or "none", *inner]
    speaks = defaultdict(list)
    for i, (score, line, name) in own.items():
        if line == 0:
            speaks[tuple(folder[i])].append((-score, "/".join([*folder[i], str(i)]), name))
    want = {}
    for i, _, _ in rows:
        above = [p for k in range(len(folder[i]), 0, -1) if (p := tuple(folder[i][:k])) in speaks]
        if i in own:
            want[i] = (own[i][2], own[i][0], "own", None)
        elif above:
            score, _, name = min(speaks[above[0]])
            want[i] = (name, -score, "inherited", "/".join(above[0]))
        else:
            want[i] = (None, None, "none", None)
    got = {r["doc_id"]: (r["license"], r["score"], r["origin"], r["from_dir"]) for r in QUERIES["op3_license_scan"](spark, sf_dir).collect()}
    assert own and got.keys() == want.keys()
    for i, (name, score, origin, where) in want.items():
        assert got[i][0] == name and got[i][2:] == (origin, where), i
        assert score is None or abs(got[i][1] - score) <= 2e-6, i


def test_sql_gives_the_same_rows(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf_dir)
        want = con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), name


def test_languages_of_the_smoke_tables(spark, sf_dir):
    """Every whole text compressed by plain calls, in blocks, with each dictionary; the dictionaries hold words of the learning part alone."""
    docs = rows_of(sf_dir, "documents", "doc_id, text, lang")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs}
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").where(language.fold() != 2))
    assert model.languages == sorted({lang for i, _, lang in docs if lang is not None and not held[i]})

    def plain(text):
        kept = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower())
        return " ".join(x for x in kept.split(" ") if x).encode("utf-8", "replace")

    for lang, dictionary in zip(model.languages, model.dictionaries, strict=True):
        known = {w for i, t, x in docs if x == lang and not held[i] for w in plain(t or "").split()}
        words = dictionary.split()
        assert len(words) > 50 and sum(w in known for w in words) > 0.95 * len(words)  # excerpts may begin and end inside a word
    coders = [zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for d in model.dictionaries]
    want = {}
    for i, text, _ in docs:
        if not text or not any(c.isalpha() for c in text):
            want[i] = (held[i], "und", 0.0)
            continue
        data = plain(text)
        sizes = [sum(len(c.compress(data[k : k + language.BLOCK_BYTES])) for k in range(0, max(1, len(data)), language.BLOCK_BYTES)) for c in coders]
        low = min(sizes)
        want[i] = (held[i], model.languages[sizes.index(low)], round(1 / sum(math.exp(-language.SHARPNESS * (x - low) / low) for x in sizes), 9))
    got = {r.doc_id: (r.held_out, r.lang_pred, round(r.score, 9)) for r in QUERIES["op4_language_id"](spark, sf_dir).collect()}
    assert got == want
    right = [want[i][1] == lang for i, text, lang in docs if held[i] and lang and want[i][1] != "und"]
    assert len(right) > 20 and sum(right) > 0.9 * len(right)
