"""Literal fixtures for the Korean rules, and comparisons with plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import articles, chunks, names, paths, text as tx, urls
from clauseflow.sources import files


def column(spark, values, *exprs, schema="x string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"_i int, {schema}")
    out = df.select("_i", *[e.alias(f"c{n}") for n, e in enumerate(exprs)]).orderBy("_i").collect()
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in out]



def X():
    return F.col("x")


def test_clean_text_equals_python(spark):
    random.seed(1)
    alphabet = "ab처리 \t\n.,1½_-　"
    samples = ["처리목적처리목적 내용", "a  b\n\n\nc", "thth haha. 2020 _a_a x½½½½"] + [
        "".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(3000)
    ]

    def python(t):
        t = re.sub(r"[ \t]+", " ", t)
        t = re.sub(r"\n{2,}", "\n", t)
        return re.sub(r"\b(\S{2,10})\1\b", r"\1", t).strip()

    got = column(spark, samples, tx.clean_text(X()))
    assert got[0] == "처리목적 내용"
    assert got == [python(t) for t in samples]


def test_document_hash_ignores_every_space(spark):
    got = column(spark, ["a b　c\n", "abc"], tx.document_hash(X()))
    assert got[0] == got[1] == hashlib.md5(b"abc").hexdigest()


def test_white_space_is_pythons():
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == set(V.WHITESPACE)


@pytest.mark.parametrize("chunk, label, number", [
    ("제 12 조의 3 (환불)", "제12조의3", "12조의3"),
    ("본문 제7조에 따라 제8조", "제7조", "7조"),
    ("2.7. Refund Requests", "2.7.", "2.7"),
    ("1234. no section", "unknown", "unknown"),
    ("[환불]\nbody", "[환불]", "unknown"),
    ("  [ 환불 ] body", "[환불]", "unknown"),
    ("body", "unknown", "unknown"),
])
def test_articles(spark, chunk, label, number):
    assert column(spark, [chunk], articles.article_label(X()), articles.article_number(X())) == [(label, number)]


def test_keywords_count_both_spellings(spark):
    assert column(spark, ["청약철회 되나요", "제3자제공"], tx.keywords_in(X())) == [["청약철회", "청약 철회"], ["제3자 제공"]]
    words = F.array(F.lit("청약철회"), F.lit("청약 철회"), F.lit("환불"))
    assert column(spark, ["청약 철회는 7일"], tx.keyword_matches(X(), words)) == [2]


def test_capitals_letter_by_letter(spark):
    words = ["ungeheitß", "straße", "abc", "", None, "ŉa", "ﬁx", "ᾳ", "İi", "über", "제1조 é𐐨"]
    got = column(spark, words, tx.upper_letters(X()))
    want = ["UNGEHEITẞ", "STRAẞE", "ABC", "", None, "ŉA", "ﬁX", "ᾼ", "İI", "ÜBER", "제1조 É𐐀"]
    assert [r[0] if isinstance(r, tuple) else r for r in got] == want


def test_names(spark):
    asked = ["Netflix", "넷플릭스", "Spotify", " TVING ", "  "]
    assert column(spark, asked, names.canonical_name(X())) == ["넷플릭스", "넷플릭스", "Spotify", "티빙", None]
    assert column(spark, ["Netflix", "무명", ""], names.alias_names(X())) == [["Netflix", "넷플릭스"], ["무명"], []]
    assert column(spark, ["youtube premium kr", "유튜브", "Foo (Bar)", " x "], names.display_name(X())) == [
        "유튜브 프리미엄 (YouTube Premium)", "유튜브 (YouTube)", "Foo (Bar)", "x",
    ]
    assert column(spark, ["a/b: c. ", "ＡＢ＋", " ... "], names.folder_name(X())) == ["a_b_ c", "AB+", "unnamed_service"]


def test_paths(spark):
    got = column(
        spark, ["/r/terms/tving/terms.txt", "/r/law/a.tar.txt", "/terms", "/r/x/개인정보.pdf"],
        paths.doc_type(X()), paths.service_name(X(), paths.doc_type(X())), paths.doc_subtype(X()), paths.file_stem(X()),
    )
    assert got == [
        ("terms", "tving", "terms_of_use", "terms"), ("law", "none", "unknown", "a.tar"),
        ("terms", "unknown", "terms_of_use", "terms"), ("unknown", "none", "privacy_policy", "개인정보"),
    ]
    assert column(spark, ["/faq/kca.json", "/faq/s/a.json", "/terms/t/a.json"], paths.faq_service_name(X())) == ["none", "s", "t"]


def test_urls(spark):
    domain = F.lit("a.com")
    assert column(spark, ["https://help.a.com/x", "nota.com", "a.com", ""], urls.in_domain(X(), domain)) == [True, False, True, False]
    hosts = ["https://netflix.com", "https://x.com/a", "https://www.google.co.kr", "ftp://a.com"]
    assert column(spark, hosts, urls.is_usable_url(X()), urls.is_usable_url(X(), match="substring")) == [
        (True, False), (False, False), (False, False), (False, False),
    ]
    assert column(spark, ["HTTPS://U:p@[::1]:80/", "a.b:8080"], urls.host_name(X())) == ["::1", "a.b"]


def test_policy_page_needs_words_and_length(spark):
    got = column(spark, ["서비스 이용약관" + " 가" * 150, "이용약관", "메뉴" * 200],
                 urls.is_policy_page(F.lit("https://a.com"), F.lit(""), X(), V.POLICY_KEYWORDS["terms"]))
    assert got == [True, False, False]


def test_decoding(spark):
    text = "약관 전문입니다"
    data = [
        text.encode("utf-8"), text.encode("utf-8-sig"), text.encode("utf-16"), text.encode("cp949"),
        "쀍".encode("cp949"), b"\xff", None,
    ]
    got = column(spark, data, files.decode_text(X()), schema="x binary")
    assert got == [text, text, text, text, "쀍", None, None]


def test_first_lists_win(spark):
    assert column(spark, ["환불 및 이용약관", "자동결제 환불", "none"], tx.first_label(X(), V.DOC_SUBTYPE_KEYWORDS, "unknown")) == [
        "terms_of_use", "refund_policy", "unknown",
    ]


# --------------------------------------------------------------------- chunking
def fold(parts, low):
    """Short parts folded, told step by step."""
    done, open_ = [], []
    for part in parts:
        if len(part) >= low:
            if open_:
                done.append("\n".join(open_))
            done.append(part)
            open_ = []
        else:
            open_.append(part)
            if len("\n".join(open_)) >= low:
                done.append("\n".join(open_))
                open_ = []
    if open_:
        rest = "\n".join(open_)
        done[-1:] = [done[-1] + "\n" + rest] if done else [rest]
    return done


def test_merge_short(spark):
    random.seed(2)
    samples = [["aa", "bbbbbb", "c"], ["aa", "bb", "cccccc"], [], ["a"]] + [
        ["x" * random.randint(1, 9) for _ in range(random.randint(0, 12))] for _ in range(500)
    ]
    got = column(spark, samples, chunks.merge_short(X(), 5), schema="x array<string>")
    assert got[0] == ["aa", "bbbbbb\nc"] and got[1] == ["aa\nbb", "cccccc"]
    assert got == [fold(s, 5) for s in samples]


def slide(pieces, size, overlap):
    """Windows over short pieces, held as a list that grows and is popped from the left."""
    out, held = [], []
    for piece in pieces:
        if held and sum(map(len, held)) + len(piece) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                held.pop(0)
        held.append(piece)
    if held:
        out.append("".join(held))
    return out


def by_separators(text, size, overlap, marks):
    """The recursive splitter told from its description: cut, keep the mark in front, recurse."""
    mark = next(m for m in marks if m == "" or m in text)
    rest = marks[marks.index(mark) + 1:]
    if mark == "":
        pieces = list(text)
    else:
        first, *others = text.split(mark)
        pieces = [p for p in [first] + [mark + o for o in others] if p]
    out, short = [], []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        out += slide(short, size, overlap)
        short = []
        out += by_separators(piece, size, overlap, rest) if rest else [piece]
    return out + slide(short, size, overlap)


def test_recursive_windows(spark):
    random.seed(3)
    samples = [
        "".join(random.choice("abcdef  \n") if random.random() < density else "x" for _ in range(random.randint(0, 300)))
        for density in (0.05, 0.3, 0.9) for _ in range(300)
    ] + ["a\n\nb" * 40, "", "   "]
    got = column(spark, samples, chunks.recursive_windows(X(), 40, 12))
    for text, windows in zip(samples, got):
        text = text.strip()
        want = [text] if len(text) <= 40 else [w.strip() for w in by_separators(text, 40, 12, ["\n\n", "\n", " ", ""])]
        assert windows == [w for w in want if w], repr(text)


def headed(text):
    """Heading sections, line by line."""
    sections, lines, title = [], [], "본문"
    for line in text.splitlines():
        bare = line.strip()
        if lines and 2 <= len(bare) <= 20 and not bare.endswith(V.HEADING_ENDINGS):
            sections.append((title, lines))
            title, lines = bare, [line]
        else:
            lines.append(line)
    sections.append((title, lines))
    bodies = [(t, "\n".join(ls).strip()) for t, ls in sections]
    return [f"[{t}]\n{b}" for t, b in bodies if b]


def test_split_headings(spark):
    random.seed(4)
    lines = ["환불 안내", "본문 내용을 길게 적은 줄입니다 정말로 길어요", "", " 짧은 제목 ", "끝.", "a", "가나다", "x" * 20, "x" * 21, "제목:", "\tTab\x1f"]
    samples = ["\n".join(random.choice(lines) for _ in range(random.randint(1, 12))) for _ in range(400)]
    samples += ["a\r\nbb\x0bcc dd", "제목\n"]
    assert column(spark, samples, chunks.split_headings(X())) == [headed(s) for s in samples]


def test_pattern_splits_equal_python(spark):
    random.seed(5)
    bits = ["제1조", "제 2 조의3 ", "1. x", "2.1. y\n", "\n", " ", "가나다", "1.\n", "\n3. z", "12345. q"]
    samples = ["".join(random.choice(bits) for _ in range(random.randint(1, 14))) for _ in range(600)]
    for pattern, python in (
        (chunks.BEFORE_ARTICLE, r"(?=제\s*\d+\s*조(?:\s*의\s*\d+)?)"),
        (chunks.BEFORE_OUTLINE, r"(?m)(?=^\d{1,3}(?:\.\d+)*\.\s+.+$)"),
        (chunks.BEFORE_GUIDELINE, r"(?m)(?=^\s*\d+\.\s+.+$)"),
    ):
        want = [[p.strip() for p in re.split(python, s) if p.strip()] for s in samples]
        assert column(spark, samples, chunks.split_before(X(), pattern)) == want


def test_long_outline_numbers_do_not_overflow(spark):
    number = "1" + ".1" * 20000 + "."
    assert column(spark, [number + " title", "1..2. x"], articles.article_label(X())) == [number, "unknown"]
    assert column(spark, [number + " a\n2. b\n3. c"], F.size(chunks.split_before(X(), chunks.BEFORE_OUTLINE))) == [3]
