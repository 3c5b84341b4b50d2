"""Manifests, lock files and their closure on small repositories."""

import pytest

from marlstone.operators import packages as P

MANIFEST = '{"name": "auth", "dependencies": {"@s/logger": "2.1.0", "pino": "^9.14.0", "odd": {"specifier": "1.x"}}, "devDependencies": {"typescript": "^5.9.0"}}'
LOCK = """lockfileVersion: '9.0'

importers:

  other:
    dependencies:
      pino:
        specifier: ^1
        version: 1.0.0
  .:
    dependencies:
      '@s/logger':
        specifier: 2.1.0
        version: 2.1.0(pino@9.14.0)
      pino:
        specifier: ^9.14.0
        version: 9.14.0
    devDependencies:
      typescript: 5.9.3

packages:

  '@s/logger@2.1.0': {}

snapshots:

  '@s/logger@2.1.0(pino@9.14.0)':
    dependencies:
      pino: 9.14.0
      sonic: 4.0.0
    optionalDependencies:
      sonic: 4.1.0
      gone: 1.0.0
  '@s/logger@2.1.0(pino@8.0.0)':
    dependencies:
      pino: 8.0.0
  pino@9.14.0:
    dependencies:
      back: 1.0.0
  back@1.0.0:
    dependencies:
      pino: 9.14.0
  sonic@4.1.0: {}
"""


@pytest.fixture(scope="module")
def found(spark):
    manifests = spark.createDataFrame([("a", MANIFEST, "auth"), ("b", MANIFEST, "b"), ("n", None, "n"), ("x", "no json", "x"), ("o", '{"name": "o", "dependencies": {"pino": "^1"}}', "other")], "repo_id string, text string, root string")
    locks = spark.createDataFrame([("a", LOCK), ("o", LOCK.replace("  .:", "  ..:"))], "repo_id string, text string")
    return P.closure(manifests, locks), P.reports(manifests, locks)


def of(df, repo, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect() if r.repo_id == repo), key=str)


def test_direct(found):
    want = [("@s/logger", "2.1.0", "dependencies", "2.1.0", "pnpm-lock.yaml"), ("odd", "1.x", "dependencies", None, "package.json"), ("pino", "^9.14.0", "dependencies", "9.14.0", "pnpm-lock.yaml"), ("typescript", "^5.9.0", "devDependencies", "5.9.3", "pnpm-lock.yaml")]
    assert of(found[0].dependencies, "a", "name", "specifier", "scope", "version", "source") == want
    assert [r[3] for r in of(found[0].dependencies, "b", "name", "specifier", "scope", "version")] == [None] * 4
    assert of(found[0].dependencies, "o", "name", "version") == [("pino", "1.0.0")]


def test_closure(found):
    edges = of(found[0].edges, "a", "from_name", "to_name", "version", "scope", "depth")
    assert [e for e in edges if e[4] > 0] == [
        ("@s/logger", "gone", "1.0.0", "optionalDependencies", 1), ("@s/logger", "pino", "9.14.0", "dependencies", 1), ("@s/logger", "sonic", "4.1.0", "optionalDependencies", 1),
        ("back", "pino", "9.14.0", "dependencies", 2), ("pino", "back", "1.0.0", "dependencies", 1),
    ]
    assert len([e for e in edges if e[4] == 0]) == 4 and {e[0] for e in edges if e[4] == 0} == {"auth"} and len(of(found[0].edges, "b", "to_name")) == 4


def test_gaps(found):
    assert of(found[0].gaps, "a", "gap") == [("No lockfile resolution for odd",), ("No lockfile snapshot for gone@1.0.0",), ("No lockfile snapshot for typescript@5.9.3",)]
    assert of(found[0].gaps, "b", "gap") == [("pnpm-lock.yaml not found",)]
    for r in "nx":
        assert of(found[0].gaps, r, "gap") == [("package.json has no name and no dependencies",), ("pnpm-lock.yaml not found",)]


def test_reports(found):
    assert of(found[1], "a", "package", "n_dependencies", "n_edges", "packages", "depth", "n_gaps", "complete") == [("auth", 4, 9, 6, 2, 3, False)]
    assert of(found[1], "n", "package", "n_dependencies", "n_edges", "complete") == [(None, 0, 0, False)]


def test_rounds_read_what_still_goes_on(spark, monkeypatch):
    """Repositories that are done leave the rounds: late ones do not read all that depends on anything."""
    folder = lambda f: f.rsplit("/", 1)[0]
    children, rounds = set(), []

    def keep(self, df, whole=P.Rounds.keep):
        reads = {folder(f) for f in df.inputFiles()}
        out = whole(self, df)
        if "depth" in df.columns:
            rounds.append(bool(reads & children))
        elif not children and {"to_name", "source"} <= set(df.columns):
            children.update(folder(f) for f in out.inputFiles())
        return out

    monkeypatch.setattr(P.Rounds, "keep", keep)

    def lock(n):
        chain = "".join(f"  p{i}@1.0.0:\n    dependencies:\n      p{i + 1}: 1.0.0\n" for i in range(n))
        return f"importers:\n  .:\n    dependencies:\n      p0:\n        specifier: ^1\n        version: 1.0.0\nsnapshots:\n{chain}  p{n}@1.0.0:\n"

    deep = {f"r{k}": 1 for k in range(4)} | {"long": 4}
    manifests = spark.createDataFrame([(r, '{"name": "x", "dependencies": {"p0": "^1"}}', r) for r in deep], "repo_id string, text string, root string")
    locks = spark.createDataFrame([(r, lock(n)) for r, n in deep.items()], "repo_id string, text string")
    found = P.closure(manifests, locks)
    assert sorted((r.repo_id, r.to_name, r.depth) for r in found.edges.collect()) == sorted((r, f"p{i}", i) for r, n in deep.items() for i in range(n + 1))
    assert not found.gaps.count() and rounds[0] and not rounds[-1]
