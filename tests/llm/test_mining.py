"""Spelling variants, exact groups and collocations against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SMALL

from larder.llm import exact, queries, setm, spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, SMALL, "documents").select("doc_id", "text", "lang").orderBy("doc_id").collect()


def of(spark, name):
    return queries.QUERIES[name](spark, SMALL).collect()


# Spelling variants


def near(u, v):
    """One code point inserted, deleted or replaced, tried one by one."""
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def plain_variants(words, candidates=None):
    out = {}
    for w, n in words.items():
        others = [v for v in (candidates(w) if candidates else words) if v != w and near(v, w)]
        best = min(others, key=lambda v: (-words[v], v)) if others else None
        form = best if best and words[best] >= 2 * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    for w, (form, *rest) in list(out.items()):
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (form, *rest, root)
    return out


def shaped(rows):
    return {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in rows}


def test_variants_equal_brute_force_on_documents(spark, docs):
    counts = Counter()
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    by_shape = defaultdict(set)  # one of two halves and a length of one more or less is shared
    for w in words:
        by_shape[w[:2]].add(w)
        by_shape[w[-2:]].add(w)
    want = plain_variants(words, lambda w: by_shape[w[:2]] | by_shape[w[-2:]])
    rows = of(spark, "op11_spelling")
    assert len(rows) == len(want) and shaped(rows) == want
    assert any(v[0] for v in want.values())


@pytest.mark.parametrize("block", [1, 7, 20_000])
def test_variants_in_windows_of_any_size(spark, block):
    """With tiny blocks every partition is split down to one code point."""
    draw = random.Random(block)
    words = {"".join(draw.choice("abß") for _ in range(draw.randint(1, 6))): draw.randint(1, 40) for _ in range(250)}
    words |= {"x" * n: n for n in range(1, 30)} | {"日本語": 3, "日本": 9, "😀日本": 2}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = spelling.variants(table, block=block).collect()
    assert len(rows) == len(words) and shaped(rows) == plain_variants(words)


def test_least_acceptor_has_no_two_states_alike():
    draw = random.Random(1)
    words = sorted({"".join(draw.choice("ab") for _ in range(6)) for _ in range(40)})
    machine = spelling.Acceptor()
    start = machine.add(words)
    assert sorted(machine.accepted(start)) == words
    languages = [tuple(sorted(machine.accepted(q))) for q in range(len(machine.arcs))]
    assert len(set(languages)) == len(languages)
    assert machine.add(words) == start and len(machine.arcs) == len(languages)


def test_chains_of_forms_end_at_the_root(spark):
    chain = {"abcde" + "x" * i: 3 * 2**i for i in range(12)}
    rows = spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert {r.root for r in rows} == {"abcde" + "x" * 11}


def test_variants_of_odd_rows(spark, odd, none):
    words = {r.word: r.n for r in spelling.vocabulary(odd, least=1, every=0).collect()}
    want = Counter()
    for r in odd.collect():
        want.update(w for w in re.findall("[A-Za-zÀ-ÿ]+", (r.text or "").translate(LOWER)) if len(w) >= 5)
    assert words == want
    assert spelling.variants(spelling.vocabulary(none)).collect() == []
    blank = spark.createDataFrame([("", 5), (None, 4), ("a", 3)], "word string, n long")
    assert shaped(spelling.variants(blank).collect()) == {"": (None, 5, 0, None, ""), "a": (None, 3, 0, None, "a")}


# Exact groups


def plain_groups(rows):
    found = defaultdict(list)
    for key, text in rows:
        found[re.sub("[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key is None, key if key is not None else 0))
    out = []
    for norm, members in found.items():
        members.sort()
        first = None if members[0][1] else members[0][2]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(None if m[1] else m[2], first, len(members), i == 0, digest) for i, m in enumerate(members)]
    return sorted(out, key=str)


def flat(rows):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in rows], key=str)


def test_exact_groups_on_documents(spark, docs):
    rows = sorted([tuple(r) for r in of(spark, "op12_exact")], key=str)
    assert rows == plain_groups([(r.doc_id, r.text) for r in docs])


def test_exact_groups_of_odd_rows(odd, none):
    assert flat(exact.groups(odd, every=True).collect()) == plain_groups([(r.doc_id, r.text) for r in odd.collect()])
    assert exact.groups(none).collect() == [] and exact.keep_one(none).collect() == []
    kept = exact.keep_one(odd)
    assert kept.columns == odd.columns
    want = [g for g in plain_groups([(r.doc_id, r.text) for r in odd.collect()]) if g[3]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(g[0]) for g in want)


def test_exact_groups_spread_hot_ones(spark):
    """More than a thousand copies are a hot group; whole rows repeated are among them."""
    rows = [(i % 1400, "same  text" if i % 3 else "same text") for i in range(2000)] + [(5000 + i, f"text {i}") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert flat(exact.groups(table, every=True).collect()) == plain_groups(rows)


def test_only_suspects_are_read_whole(spark):
    rows = [(1, "abc d"), (2, "abcd"), (3, "abcx"), (4, "a much longer text")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.size, r.n) for r in exact.shared_beginnings(table).collect()] == [(4, 2)]
    assert {r.doc_id: r.digest is None for r in exact.digests(table).collect()} == {1: False, 2: False, 3: True, 4: True}
    long = [(1, "x" * 64 + "a"), (2, "x" * 64 + "b")]  # one length and one beginning, but unlike
    found = exact.groups(spark.createDataFrame(long, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found} == {(1, 1, 1, True), (2, 2, 1, True)}


# Collocations


def plain_collocations(rows, support, longest=5, share=100, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        often = {p: f for p, f in found.items() if f >= support}
        ranked = []
        for p, a in often.items():
            inside = any(100 * f >= share * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in often.items())
            if len(p) > 1 and not inside:
                score, k = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def test_collocations_on_documents(spark, docs):
    got = sorted(tuple(r) for r in of(spark, "op13_setm"))
    assert got == plain_collocations([(r.lang, r.text) for r in docs], 100) and got


@pytest.mark.parametrize("share", [100, 60])
def test_collocations_by_brute_force(spark, share):
    draw = random.Random(share)
    rows = [(draw.choice(["en", None, "de"]), "".join(draw.choice(["a", "B", "ç", "dd", "é"]) + draw.choice(["  ", " ", "\t", ". ", "\n", ", ,"]) for _ in range(60)))
            for _ in range(60)]
    table = spark.createDataFrame(rows, "lang string, text string")
    got = setm.collocations(table, support=4, share=share, top=40, longest=4).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 4, 4, share, 40)


def test_collocations_of_odd_rows(odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    got = setm.collocations(odd, support=2).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 2)
    assert setm.collocations(none).collect() == []


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch):
    f = {"x": 10**16 + 1, "y": 10**15 + 7, "x y": 10**15 + 3}
    rows = [("en", p, len(p.split()), n) for p, n in f.items()] + [("en", "", 0, 10**18 - 1)]
    monkeypatch.setattr(setm, "frequent_phrases", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, k int, f long"))
    row = setm.collocations(None).first()
    assert row.score == 1000 * f["x y"] * (10**18 - 1) // (f["x"] * f["y"])
