"""The ladder of references on small repositories."""

import pytest

from marlstone.operators import references as R

SYMBOLS = [
    ("a.run", "r", "a.ts", "A.run", "run"), ("a.help", "r", "a.ts", "help", "help"), ("a.twin1", "r", "a.ts", "A.twin", "twin"), ("a.twin2", "r", "a.ts", "B.twin", "twin"),
    ("b.sign", "r", "b.ts", "Jwt.sign", "sign"), ("b.help", "r", "b.ts", "b.help", "help"), ("b.meta", "r", "b.ts", "Metadata", "Metadata"), ("b.get", "r", "b.ts", "S.get", "get"), ("b.only", "r", "b.ts", "X.only", "only"), ("b.profile", "r", "b.ts", "P.profile", "profile"),
    ("c.profile", "r", "c.ts", "C.profile", "profile"), ("c.pair", "r", "c.ts", "C.pair", "pair"), ("d.pair", "r", "d.ts", "D.pair", "pair"), ("d.now", "r", "d.ts", "T.now", "now"), ("q.only", "q", "q.ts", "only", "only"), ("c.View", "r", "c.ts", "View", "View"),
    *[(f"m{i}", "r", f"m{i}.ts", f"M{i}.many", "many") for i in range(7)],
]
IMPORTS = [("r", "a.ts", "b.ts"), ("r", "a.ts", "b.ts"), ("r", "c.ts", "b.ts"), ("r", "e.ts", "c.ts"), ("r", "e.ts", "d.ts")]
CASES = [  # file, kind, name, receiver, src; with imports: rung, dst; without
    (("a.ts", "call", "help", None, "a.run"), ("same_file", "a.help"), ("same_file", "a.help")),
    (("a.ts", "call", "twin", None, "a.run"), ("ambiguous", None), ("ambiguous", None)),
    (("a.ts", "call", "x.Jwt.sign", None, "a.run"), ("imported", "b.sign"), ("unique", "b.sign")),
    (("a.ts", "call", "Jwt.sign", "jwt", "a.run"), ("qualified", "b.sign"), ("qualified", "b.sign")),
    (("a.ts", "call", "get", None, "a.run"), ("imported", "b.get"), ("generic", None)),
    (("d.ts", "call", "get", None, "d.now"), ("generic", None), ("generic", None)),
    (("d.ts", "call", "only", None, "d.now"), ("unique", "b.only"), ("unique", "b.only")),
    (("d.ts", "call", "only", "this.svc", "d.now"), ("unscoped", None), ("unique", "b.only")),
    (("d.ts", "type", "Metadata", None, "d.now"), ("unscoped", None), ("qualified", "b.meta")),
    (("d.ts", "call", "Metadata", None, "d.now"), ("qualified", "b.meta"), ("qualified", "b.meta")),
    (("a.ts", "call", "pair", None, "a.run"), ("guess", "c.pair"), ("guess", "c.pair")),
    (("e.ts", "call", "pair", None, "a.run"), ("ambiguous", None), ("guess", "c.pair")),
    (("a.ts", "call", "many", None, "a.run"), ("ambiguous", None), ("ambiguous", None)),
    (("m0.ts", "call", "many", None, "m0"), ("guess", "m1"), ("guess", "m1")),
    (("a.ts", "call", "now", "Date", "a.run"), ("platform", None), ("platform", None)),
    (("d.ts", "call", "now", "Date.x", "b.get"), ("same_file", "d.now"), ("same_file", "d.now")),
    (("c.ts", "call", "profile", "this.p", "c.profile"), ("imported", "b.profile"), ("unique", "b.profile")),
    (("a.ts", "call", "sign", None, "b.sign"), ("unknown", None), ("unknown", None)),
    (("a.ts", "call", "nothing", None, "a.run"), ("unknown", None), ("unknown", None)),
    (("a.ts", "call", "help", None, None), ("no_source", None), ("no_source", None)),
    (("e.ts", "jsx-component", "View", None, "a.run"), ("qualified", "c.View"), ("qualified", "c.View")),
    (("e.ts", "jsx-callback", "profile", None, "a.run"), ("imported", "c.profile"), ("ambiguous", None)),
    (("a.ts", "jsx-callback", "now", None, "a.run"), ("ambiguous", None), ("unique", "d.now")),
]


@pytest.mark.parametrize("scoped", [True, False])
def test_ladder(spark, scoped):
    refs = spark.createDataFrame([(i, "r", *c) for i, (c, _, _) in enumerate(CASES)] + [(99, "r", "a.ts", "other", "help", None, "a.run")], "ref_id int, repo_id string, file_path string, kind string, raw_name string, receiver string, src string")
    symbols = spark.createDataFrame(SYMBOLS + SYMBOLS[:3], "symbol_id string, repo_id string, file_path string, qualified_name string, name string")
    imports = spark.createDataFrame(IMPORTS, "repo_id string, file_path string, imported string")
    found = R.resolved(refs, symbols, imports if scoped else None)
    rows = {r.ref_id: r for r in found.collect()}
    assert {i: (r.rung, r.dst) for i, r in rows.items()} == {i: c[1 if scoped else 2] for i, c in enumerate(CASES)}
    guess = [i for i, r in rows.items() if r.rung == "guess"]
    assert all(rows[i].method == "INFERRED" and rows[i].confidence == (1 / 6 if CASES[i][0][2] == "many" else 0.5) for i in guess)
    assert all((r.method, r.confidence) == ("INFERRED", 0.5) for r in rows.values() if r.edge_type in ("renders", "invokes_dynamic") and r.dst)
    assert all((r.method, r.confidence) == ("EXTRACTED", None) for r in rows.values() if r.edge_type == "calls" and r.dst and r.rung != "guess")
    if scoped:
        assert {(r.file_path, r["name"]) for r in R.second_pass(found, refs, imports).collect()} == {("a.ts", "nothing"), ("a.ts", "sign")}
