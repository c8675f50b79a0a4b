"""Fill-in-middle, vector codes and license scans against plain versions, with odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseflow.llm import licenses, middle, vector_codes

DOCS = "doc_id long, text string, doc string, draws string, output string, label string, n int, form string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", "x", "o", "l", 1, "f") for i, t in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --------------------------------------------------------------------- 11
def plain_middle(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), sha("7:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return doc_id, n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts_of_lines():
    rng = random.Random(3)
    out = ["", None, "\n", "\n\n\n", "one", "one\n", "a\r\nb\n", "é👍\nß\n\n字", "x<P>y\nz", "<S", "P>\n<M", "half<\nS>\n"]
    out += ["".join(rng.choice(["ab", "\n", "é", "👍 ", "<"]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    out += ["\n" * 70_000, "a\n" * 90_000, "word " * 30_000 + "\nend", "x" * 65_535 + "\n" + "y" * 65_535 + "\n", "".join(
        rng.choice("ab\n") for _ in range(200_000))]
    return out


@pytest.mark.parametrize("kind", [middle.Array, middle.Bitmap, middle.Runs])
def test_containers_select(kind):
    rng = random.Random(kind.__name__)
    for size in (1, 2, 64, 5_000, 65_536):
        low = np.array(sorted(rng.sample(range(65_536), size)))
        held = kind(low)
        for rank in {0, size - 1, *(rng.randrange(size) for _ in range(50))}:
            assert held.select(rank) == low[rank]


def test_containers_are_chosen_by_size():
    assert isinstance(middle.container(np.arange(100, 50_000)), middle.Runs)
    assert isinstance(middle.container(np.arange(0, 65_536, 7)), middle.Bitmap)
    assert isinstance(middle.container(np.arange(0, 65_536, 70)), middle.Array)


def test_boundaries_equal_line_ends():
    for text in texts_of_lines():
        ends, at = [0], 0
        for line in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
            at += len(line)
            ends.append(at)
        held = middle.Boundaries(text or "")
        ranks = range(len(ends)) if len(ends) < 500 else random.Random(1).sample(range(len(ends)), 300)
        assert len(held) == len(ends) and all(held.select(k) == ends[k] for k in ranks)


def test_fill_in_middle_equals_plain_version(spark):
    rows = list(enumerate(texts_of_lines())) + [(3, "again\nand\nagain"), (3, "again\nand\nagain"), (None, "a\nb\nc\n"), (None, None)]
    out = middle.fill_in_middle(frame(spark, rows))
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted((plain_middle(*r) for r in rows), key=repr)
    back = out.select("doc_id", middle.restored("output", "form").alias("text")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_fill_in_middle_ids_marks_and_rates(spark):
    rows = spark.createDataFrame([("k1", "a\nb\n"), (None, "<P>")], "name string, body string")
    out = middle.fill_in_middle(rows, "name", "body", marks=("(.)", "[", "$"), rate=100, spm_rate=0)
    assert {r["form"] for r in out.collect()} == {"psm"}
    back = out.select(middle.restored("output", "form", ("(.)", "[", "$"))).collect()
    assert sorted(r[0] for r in back) == ["<P>", "a\nb\n"]
    assert middle.fill_in_middle(rows, "name", "body", rate=0).where("form <> 'plain'").count() == 0
    assert middle.fill_in_middle(frame(spark, [])).count() == 0


# --------------------------------------------------------------------- 12
def plain_codes(rows, parts=16, entries=64, rounds=2):
    """[(id, label, code, error)] and the codebooks, from lists of numbers, part by part."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], []
    width = len(kept[0][1])
    piece = -(-width // parts)

    def cut(v):
        whole = [math.floor(256 * x) for x in v] + [0] * (piece * parts - width)
        return [whole[p * piece : (p + 1) * piece] for p in range(parts)]

    fit = [cut(r[1]) for r in kept if len(r[1]) == width]
    books = [[c[p] for c in fit[:entries]] for p in range(parts)]

    def nearest(book, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for c in fit:
                members.setdefault(nearest(book, c[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else e for k, e in enumerate(book)]
    out = []
    for name, v, label in kept:
        found = [nearest(book, c) for book, c in zip(books, cut(v))] if len(v) == width else None
        out.append((name, label, found and "".join(f"{k:02x}" for _, k in found), found and sum(d for d, _ in found)))
    return out, books


VECTORS = "vec_id long, embedding array<float>, label int, vec string, code string, error string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "v", "c", "e", 1) for i, v, k in rows], VECTORS)


def single(v):
    return [None if x is None else float(np.float32(x)) for x in v]


def check_codes(spark, rows):
    rows = [(i, v if v is None else single(v), k) for i, v, k in rows]
    codes, books = vector_codes.vector_codes(vectors(spark, rows))
    want, plain = plain_codes(rows)
    assert sorted(map(tuple, codes.collect()), key=repr) == sorted(want, key=repr)
    assert books.tolist() == plain or (not plain and not books.size)
    return codes, want


def test_vector_codes_equal_plain_version(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(i, rows[5][1], 7) for i in range(300, 420)]  # a common vector
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[8][1], 2)]  # repeated rows, a null id
    rows += [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] + [0.0] * 31, 2)]
    rows += [(904, [0.5] * 31, 3), (905, [], 3)]  # other widths
    codes, want = check_codes(spark, rows)
    out = vector_codes.label_errors(codes).collect()
    total = {}
    for _, label, _, error in want:
        total[label] = total.get(label, 0) + (error or 0)
    assert len(out) == len(want) and all(r["label_error"] == (total[r["label"]] if r["label"] != 3 else None) for r in out)


@pytest.mark.parametrize("width, n", [(16, 5), (20, 90), (3, 70), (64, 64), (0, 4)])
def test_vector_codes_of_odd_shapes(spark, width, n):
    rng = random.Random(width)
    check_codes(spark, [(i, [rng.randrange(-3, 4) / 256 for _ in range(width)], 1) for i in range(n)])  # many ties


def test_vector_codes_of_large_components_and_empty_tables(spark):
    codes, _ = vector_codes.vector_codes(vectors(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, None)]))
    assert [r["error"] for r in codes.collect()] == [0, 0, 0]
    codes, books = vector_codes.vector_codes(vectors(spark, [(1, None, 1)]))
    assert vector_codes.label_errors(codes).count() == 0 and books.size == 0
    names = T.StructType([T.StructField("k", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.StringType())])
    some = spark.createDataFrame([("a", [0.25, 0.5], "l"), ("b", [0.0, 0.0], None)], names)
    codes, books = vector_codes.vector_codes(some, "k", "x", "y", parts=2, entries=1, rounds=1)
    assert books.tolist() == [[[32]], [[64]]]
    assert sorted(map(tuple, codes.collect())) == [("a", "l", "0000", 32**2 + 64**2), ("b", None, "0000", 32**2 + 64**2)]


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(4)
    for _ in range(40):
        points = rng.integers(-9, 9, (200, 3))
        entries = rng.integers(-9, 9, (20, 3))
        at, error = vector_codes.assign(points, entries)
        distances = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (at == distances.argmin(axis=1)).all() and (error == distances.min(axis=1)).all()


def test_hilbert_neighbours_are_one_cell_apart():
    for bits, dims in ((3, 2), (2, 3), (2, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        places = vector_codes.hilbert(cells, bits)
        assert sorted(places) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1) == 1).all()


# --------------------------------------------------------------------- 13
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES):
    w = words(text)
    places = [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    joined = " " + " ".join(w) + " "
    parsed = [(label, licenses.parse(markup)) for label, markup in templates]
    own = [(label, nodes) for label, nodes in parsed if re.search(licenses.pattern(nodes) + " ", joined)]
    said = max([len(p.split()) for p, label in phrases.items() if label in {b for _, b in places}] + [licenses.mandatory(n) for _, n in own], default=0)
    starts = [i for i, _ in places]
    base = {label for _, label in places}
    return (
        len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {label for label, _ in own})), round(1 - 2 ** (-said / 4), 6),
    )


def filled(markup, rng):
    """A text that a template accepts, its regions filled at random."""
    def region(m):
        given = dict(re.findall(r'(\w+)="([^"]*)"', m[1]))
        if "words" in given:
            least, most = map(int, given["words"].split("-"))
            return " ".join(rng.choice(["the", "authors", "or", "holder", "Ünal"]) for _ in range(rng.randint(least, most)))
        return rng.choice(given["match"].split("|"))

    text = re.sub(r"<<(var;.*?)>>", region, markup)
    while "<<beginOptional>>" in text:
        text = re.sub(r"<<beginOptional>>((?:(?!<<beginOptional>>).)*?)<<endOptional>>", lambda m: rng.choice(["", m[1]]), text, flags=re.S)
    return text


def license_texts():
    rng = random.Random(11)
    out = [None, "", " \n", "mit", "MIT License", "the mit-license; MIT  LICENSE! Apache License", "summit license", "cc by cc by cc", "CC BY-NC 4.0",
           "mit mit license license", "ÉMIT license", "mit license", "mit\x00license", "permission is hereby granted", "mit license " * 500]
    for label, markup in licenses.TEMPLATES:
        for _ in range(4):
            good = filled(markup, rng)
            out += [f"some words before. {good} And after.", good]
            w = good.split()
            at = rng.randrange(len(w))
            out += [" ".join([*w[:at], *w[at + 1 :]]), " ".join([*w[:at], "changed", *w[at:]])]
    pool = "licensed under the mit apache license version 2 0 cc by nc 4 a terms of v gnu general public 3".split()
    out += [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    return out


def test_license_scan_equals_plain_version(spark):
    texts = license_texts()
    rows = list(enumerate(texts)) + [(4, texts[4]), (4, texts[4]), (None, texts[5])]
    got = licenses.license_scan(frame(spark, rows)).drop("matches")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *plain_scan(t)) for i, t in rows), key=repr)
    assert licenses.license_scan(frame(spark, [])).count() == 0


def test_every_template_accepts_its_own_wording_and_no_changed_word():
    rng = random.Random(2)
    for label, markup in licenses.TEMPLATES:
        scanner = licenses.Scanner({}, [(label, markup)])
        for _ in range(10):
            good = filled(markup, rng)
            assert scanner.row(good.encode())[5] == label
    scanner = licenses.Scanner({}, [("x", "one two <<var;words=\"1-2\">> three")])
    assert scanner.row(b"one two three")[5] == "" and scanner.row(b"one two a b c three")[5] == ""
    assert scanner.row(b"ONE two, a three")[7] == [{"label": "x", "first": 0, "last": 3}]


def test_spans_across_pieces_and_bounded_states(monkeypatch):
    monkeypatch.setattr(licenses, "PIECE", 40)
    monkeypatch.setattr(licenses, "STATES", 8)
    rng = random.Random(6)
    templates = [("a", 'the <<var;words="0-6">> end'), ("b", "x <<beginOptional>>y<<endOptional>> z")]
    scanner = licenses.Scanner({"x z": "p"}, templates)
    for _ in range(200):
        text = " ".join(rng.choice(["the", "end", "x", "y", "z", "q"]) for _ in range(80))
        w = text.split()
        want = {("p", i, i + 1) for i in range(80) if w[i : i + 2] == ["x", "z"]}
        want |= {("b", i, i + len(t) - 1) for i in range(80) for t in (["x", "z"], ["x", "y", "z"]) if w[i : i + len(t)] == t}
        for j in range(80):
            starts = [i for i in range(max(0, j - 7), j) if w[i] == "the"]
            if w[j] == "end" and starts:
                want.add(("a", min(starts), j))
        assert {(m["label"], m["first"], m["last"]) for m in scanner.row(text.encode())[7]} == want
        assert len(scanner.forward.sets) <= 8


def test_markup_errors():
    for bad in ("<<beginOptional>> a", '<<var;words="0-3">>', "a <<what>> b", "a <<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.parse(bad)
