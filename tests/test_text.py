import random
import string

from pyspark.sql import functions as F

from gleaner.functions import pytext
from gleaner.operators import fragments, scope

ODD = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　"


def texts(n=400, seed=3):
    r = random.Random(seed)
    parts = [*ODD, *string.ascii_letters[:6], "#", "#+", "# KR1a0001_2", "# _tls_ x", "#pb: 1", "<pb:K1_1a>", "<pb: >", "¶", "\r\n", "正", "文", "# kr1 "]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(n)]


def column(spark, rows, expr):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return [r[1] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_strip_and_lines(spark):
    rows = texts()
    assert column(spark, rows, pytext.strip(F.col("t"))) == [t.strip() for t in rows]
    assert column(spark, rows, pytext.drop_spaces(F.col("t"))) == ["".join(t.split()) for t in rows]
    got = column(spark, rows, pytext.lines(F.col("t")))
    assert [[x for x in g if x] for g in got] == [[x for x in t.splitlines() if x] for t in rows]


CLEAN = [  # text, cleaned, compact
    ("", "", ""), (" \u3000\n\x85\t", "", ""), ("a b", "a b", "ab"), ("\u3000a\u3000b\xa0\x1f", "a\u3000b", "ab"),
    ("#+X: y\nkept", "kept", "kept"), (" #+X: y", "#+X: y", "#+X:y"), ("a\r\nb\x0bc\x1dd\u2028e", "a\nb\nc\nd\ne", "a\nb\nc\nd\ne"),
    ("# KR1a0001_2", "", ""), ("## kr3j", "", ""), ("# about KR1", "", ""), ("# xKR1a", "# xKR1a", "#xKR1a"), ("#_tls_ x", "", ""), ("# pb: 1", "", ""), ("# a pb: 1", "# a pb: 1", "#apb:1"),
    ("#", "#", "#"), ("# plain", "# plain", "#plain"), ("KR1a0001 in a line", "KR1a0001 in a line", "KR1a0001inaline"),
    ("<pb:K1_1a>", "", ""), ("a<pb:K1_1a>b¶", "ab", "ab"), ("<pb:>¶ c", "<pb:> c", "<pb:>c"), ("¶\n¶ x ¶", "x", "x"), ("<pb:a\nb>", "<pb:a\nb>", "<pb:a\nb>"),
    ("正 文 \n\n 二", "正 文\n二", "正文\n二"),
]


def test_cleaning(spark):
    rows = [t for t, _, _ in CLEAN]
    assert column(spark, rows, fragments.clean_text(F.col("t"))) == [c for _, c, _ in CLEAN]
    assert column(spark, rows, fragments.clean_text(F.col("t"), compact=True)) == [c for _, _, c in CLEAN]


def test_pages(spark):
    raw = "lost\n<pb:A_1a>冬雷 忽作¶\n<pb: >\nno id\n<pb:A_1b>\n#+X\n<pb:A_2>春风"
    df = spark.createDataFrame([("f", raw, "f_fallback_0001"), ("g", "正文内容", "g_fallback_0001"), ("h", None, "h"), ("e", "", "e")], "file string, raw_text string, fallback_piece_id string")
    got = {(r.file, r.piece_id, r.original_text) for r in fragments.fragment_rows(df).collect()}
    assert got == {("f", "A_1a", "冬雷 忽作"), ("f", "A_2", "春风"), ("g", "g_fallback_0001", "正文内容")}


def test_title(spark):
    rows = ["#+TITLE: 测试唐诗\nx", "a\n#+TITLE:  甲/乙\n", "#+TITLE: /乙", "none"]
    assert column(spark, rows, fragments.title(F.col("t"), F.lit("stem"))) == ["测试唐诗", "甲", "（未命名文献）", "stem"]


def test_scope_tokens(spark):
    assert column(spark, [" KR1a，KR1a0001  KR3j0160 "], scope.split_tokens(F.col("t"))) == [["KR1a", "KR1a0001", "KR3j0160"]]
    assert column(spark, ["kr1A", " KR ", "abc", "KR3J0160"], scope.normalize_scope(F.col("t"))) == ["KR1a", "KR", "abc", "KR3j0160"]


def test_scope_issues(spark):
    dirs = spark.createDataFrame([("KR1a0001",), ("KR1a0002",), ("KR3j0160",)], "repo_dir string")
    tokens = spark.createDataFrame(list(enumerate(["KR1a", "KR1a0001", "KR3j9999", "bad-token"])), "ord int, token string")
    good = scope.resolve_targets(tokens, dirs).orderBy("ord").collect()
    assert [(r.token, r.repo_dirs) for r in good] == [("KR1a", ["KR1a0001", "KR1a0002"]), ("KR1a0001", ["KR1a0001"])]
    assert [r.token for r in scope.scope_issues(tokens, dirs).orderBy("phase", "ord").collect()] == ["KR3j9999", "bad-token", "KR1a0001"]


def test_merge_targets(spark):
    df = spark.createDataFrame([(["KR1a", "KR3j"], ["KR3j", "kr1A0001"])], "a array<string>, b array<string>")
    assert df.select(scope.merge_targets(F.col("a"), F.col("b"))).first()[0] == ["KR1a", "KR3j", "KR1a0001"]


def test_non_negative(spark):
    assert column(spark, ["3", "-2", "x", None], pytext.non_negative(F.col("t"), 1)) == [3, 0, 1, 1]
