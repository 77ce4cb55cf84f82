"""Near spellings against plain comparison of all pairs."""

import random
from difflib import SequenceMatcher, get_close_matches

from partloom.operators import similar as S


def _codes(seed: int, n: int, prefix: str, lengths: range) -> list[str]:
    draw = random.Random(seed)
    out = [prefix + "".join(draw.choice("0123456789AB") for _ in range(draw.choice(lengths))) for _ in range(n)]
    for code in draw.sample(out, n // 2):  # misspelt copies, so that there is something to find
        t = list(code)
        for _ in range(draw.randint(1, 4)):
            i = draw.randrange(len(t))
            t[i : i + draw.randint(0, 1)] = draw.choice(["", "7", "AB", "X"])
        out.append("".join(t))
    return sorted(set(out))


def _table(spark, column: str, texts: list[str]):
    return spark.createDataFrame([(t,) for t in texts], f"{column} string")


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_close_matches_equal_all_pairs(spark):
    known = _codes(1, 400, "E00000", range(1, 9)) + _codes(2, 120, "ASSEMBLY-", range(6, 28)) + ["A", "AB", "", "Ü1"]
    wanted = _codes(3, 60, "E00000", range(1, 9)) + _codes(2, 120, "ASSEMBLY-", range(6, 28))[::3] + ["A", "", "NOTHING LIKE IT"]
    plain = {(w, x, round(SequenceMatcher(None, x, w).ratio(), 9)) for w in set(wanted) - {""} for x in get_close_matches(w, sorted(set(known) - {""}), n=3, cutoff=0.9)}
    got = S.close_matches(_table(spark, "code", wanted + wanted[:5]), _table(spark, "other", known + known[:9])).collect()
    assert {(r.code, r.other, round(r.ratio, 9)) for r in got} == plain and len(plain) > 100


def test_short_codes_need_few_letters_left_out():
    n = S.short_length(90)
    for a in range(1, n + 1):
        for b in range(1, n + 1):
            m = S.least_common(a, b, 90)
            assert m > min(a, b) or max(a, b) - m <= S.LEFT_OUT
    assert n == 16


def test_near_codes_of_one_prefix_equal_all_pairs(spark):
    known = _codes(5, 1300, "ABCDEFGHIJ", range(3, 7)) + _codes(6, 100, "1234567", range(2, 25)) + _codes(7, 60, "ABCDEFGHIJ", range(12, 30))
    wanted = (_codes(8, 40, "ABCDEFGHIJ", range(3, 7)) + _codes(6, 100, "1234567", range(2, 25))[::4] + _codes(7, 60, "ABCDEFGHIJ", range(12, 30))[::3] + ["XBCDEFGHIJ" + known[0][10:], "QQQ"])[:130]

    def root(c):
        digits = c[: len(c) - len(c.lstrip("0123456789"))]
        return digits if len(digits) >= 6 else None

    start = lambda c: c[:10] if len(c) >= 10 else c[:8]
    every, plain = sorted(set(known)), set()
    for w in set(wanted):
        pool = [x for x in every if root(x) == root(w)] if root(w) else []
        pool = pool or [x for x in every if start(x) == start(w)] or get_close_matches(w, every, n=3, cutoff=0.9)
        for x in pool:
            if x != w and ((d := _edits(w, x)) <= 2 or SequenceMatcher(None, w, x).ratio() >= 0.92):
                plain.add((w, x, min(d, 3)))
    got = S.near_codes(_table(spark, "code", wanted), _table(spark, "code", known)).collect()
    assert {(r.code, r.other, r.d) for r in got} == plain and len(plain) > 50


def test_variants_take_the_least_other_end(spark):
    known = ["123456A", "123456B", "123456", "7654321", "765432X", "ABC123456"]
    got = {r.code: r.variant.other for r in S.variants(_table(spark, "code", ["123456", "123456Q", "123456B", "7654321", "654321", "ABC"]), _table(spark, "code", known)).collect()}
    assert got == {"123456": "123456A", "123456Q": "123456", "123456B": "123456"}
    assert S.variants(_table(spark, "code", []), _table(spark, "code", known)).count() == S.near_codes(_table(spark, "code", ["Q"]), _table(spark, "code", [])).count() == 0
