"""File names and headers against targets: prefix lookups equal plain comparison of all pairs."""

import os
import random
import re

from partloom.operators import reports as P
from partloom.operators import views as V


def common(a, b):
    return max((len(os.path.commonprefix([x, y])) for x in re.findall("[0-9]+", a) for y in re.findall("[0-9]+", b)), default=0)


def cases(seed, n):
    r = random.Random(seed)
    code = lambda: "E0000" + "".join(r.choice("012") for _ in range(r.randint(2, 7)))
    return r, [(code(), r.choice(["", "A", "B", "07"])) for _ in range(n)]


def test_file_names_on_two_thousand_codes_with_one_beginning(spark):
    r, targets = cases(1, 2000)
    names = [f"{r.choice(['PRT LIST ', 'BOM 12 '])}{r.choice(targets)[0]}{r.choice(['', ' REV A', ' rev 07', ' REV X'])}" for _ in range(150)] + ["no digits", "E999999999", "E00002"]
    want = {}
    for name in set(names):
        rev = (re.search(r"\bREV\s*[-_ .]*([A-Z0-9]+)\b", name.upper()) or [None, ""])[1]
        rated = []
        for t, tr in targets:
            n = common(t, name)
            if n >= 6 and not (tr and rev and tr != rev):
                rated.append((not (tr and tr == rev), -n, t, tr))
        if rated:
            weak, n, t, _ = min(rated)
            want[name] = (t, -n, "MEDIUM" if weak else "STRONG")
    files = spark.createDataFrame([(n, n) for n in set(names)], "path string, name string")
    got = {x.path: (x.target, x.match_len, x.strength) for x in V.match_targets(files, spark.createDataFrame(targets, "target string, rev string")).collect()}
    assert got == want and len(got) > 100


def test_headers_against_all_targets(spark):
    r, targets = cases(2, 600)
    headers = [(f"b{i}", r.choice(targets)[0] if i % 3 else f"E{i}", r.choice(["", "A", "C"])) for i in range(200)] + [("z", "E77777777", "A"), ("y", "E00001111112222", "")]
    want = {}
    for bom, code, hr in headers:
        near = [(-common(t, code), t, tr) for t, tr in targets if common(t, code) >= 6]
        fit = [x for x in near if x[2] in ("", hr)]
        if fit:
            want[bom] = ("MATCH", min(fit)[1], -min(fit)[0])
        else:
            want[bom] = ("NO_NUMERIC_MATCH" if not near else "REV_MISSING" if not hr else "REV_MISMATCH", "", 0)
    rows = V.verify_headers(spark.createDataFrame(headers, "bom_id string, code string, revision string"), spark.createDataFrame(targets, "target string, rev string")).collect()
    assert {x.bom_id: (x.reason, x.target, x.match_len) for x in rows} == want and all(x.matched == (x.reason == "MATCH") for x in rows)


def test_names_and_headers_are_matched_without_sending_them_to_every_task(spark):
    """Files, targets and headers grow with the names; Spark expects far too little of their size."""
    files = spark.createDataFrame([("/f/123456 REV A.pdf", "123456 REV A.pdf", "b1")], "path string, name string, bom_id string")
    targets = spark.createDataFrame([("E123456", "A")], "target string, rev string")
    headers = spark.createDataFrame([("b1", "E123456", "A")], "bom_id string, code string, revision string")
    matches, verified = V.match_targets(files, targets), V.verify_headers(headers, targets)
    audit = P.header_audit(files, matches, headers, verified)
    assert [(r.name_target, r.strength, r.matched) for r in audit.collect()] == [("E123456", "STRONG", True)]
    assert "BroadcastHashJoin" not in audit._jdf.queryExecution().executedPlan().toString()
