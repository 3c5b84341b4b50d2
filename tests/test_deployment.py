"""Facts of deployment files."""

import pytest

from marlstone.operators import deployment as D

COMPOSE = """# services: no
services:
  web:
    image: "web:1" # the page
    depends_on:
      - db
      - cache
    volumes:
      - ./x:/y
      - type: bind
        source: /host
    environment:
      - NAME=web
    password: hunter2
  db:
    depends_on:
      cache:
        condition: started
  cache: {}
  job:
    depends_on: [db, "cache"]
volumes:
  data:
"""


def found(path, text):
    return [f for f in D.facts_of(path, text)]


def test_compose():
    got = found("deploy/compose.prod.yaml", COMPOSE)
    assert [(n, name) for n, kind, name, rel, _ in got if kind == "service" and rel is None] == [(3, "web"), (15, "db"), (19, "cache"), (20, "job")]
    assert [(n, name) for n, kind, name, rel, _ in got if rel == "depends_on"] == [(6, "db"), (7, "cache"), (17, "cache"), (21, "db"), (21, "cache")]
    assert [(n, name) for n, kind, name, rel, _ in got if rel == "mounts"] == [(9, "./x:/y"), (10, "bind"), (11, "/host")]
    assert [f for f in got if f[1] == "secret_ref"] == [(14, "secret_ref", "password", "references", "verified")] and "hunter2" not in str(got)


def test_container():
    text = "FROM --platform=linux node:20 AS build # base\nRUN a \\\n  EXPOSE 1\nexpose 80 443/tcp\nFROM nginx\nENTRYPOINT [\"run\"]\n#CMD no\ncmd go"
    assert [f[:4] for f in found("svc/Dockerfile.prod", text)] == [(1, "docker_stage", "build", "runs"), (4, "port", "80", "exposes"), (4, "port", "443/tcp", "exposes"), (5, "docker_stage", "nginx", "runs"), (6, "docker_stage", "ENTRYPOINT", "runs"), (8, "docker_stage", "cmd", "runs")]


def test_cluster():
    text = "kind: Deployment\nmetadata:\n  name: api\nspec:\n  env:\n  - name: KEY\n    valueFrom:\n      secretKeyRef:\n        name: api-keys\n  volumes:\n    - secretName: ${S}\n---\nkind: ConfigMap\nnested:\n  kind: Service\n"
    assert found("deploy/k8s/deployment.yaml", text) == [
        (1, "deployment", "Deployment", None, "verified"), (3, "config", "api", "references", "verified"), (6, "config", "KEY", "references", "verified"), (9, "secret_ref", "api-keys", "references", "verified"),
        (11, "secret_ref", "${S}", "references", "candidate"), (13, "config", "ConfigMap", None, "verified"),
    ]


def test_others():
    assert [f[2] for f in found("main.tf", 'resource "aws_s3" "logs" {\n  name = "x"\n}\nmodule "net" {\ndata "a" "b" {\n# resource "no" "no" {\n')] == ["aws_s3.logs", "module.net", "a.b"]
    assert found(".github/workflows/ci.yml", "on:\n  push:\njobs:\n  test:\n    steps:\n      - run: x\n  build:\n") == [(4, "workflow_job", "test", None, "verified"), (7, "workflow_job", "build", None, "verified")]
    assert [f[2] for f in found("charts/a/t.yaml", "x: {{ .Values.image.tag }} {{ .Values.n }} # {{ .Values.no }}")] == ["image.tag", "n"]
    assert found("notes.txt", "FROM here EXPOSE 1") == [] == found("Dockerfile", "")
    assert found("any.json", '"privateKey": "k"') == [] and [f[2] for f in found("any.yaml", "a:\n  - db_password: x\n  api-token: y\n  tokens: 3")] == ["db_password", "api-token"]


def test_rows_and_blast(spark):
    files = spark.createDataFrame([(1, "compose.yaml", "services:\n  api:\n    depends_on:\n      - Postgres\n  pg-postgres:\n"), (2, None, None), (3, "charts/x", "{{ .Values.z }}")], "doc_id long, file_path string, text string")
    facts = D.facts(files)
    assert facts.count() == 4
    got = sorted((r["name"], r.evidence) for r in D.blast_radius(facts, " postgres ").collect())
    assert got == [("Postgres", "verified"), ("pg-postgres", "candidate"), ("z", "candidate")]


@pytest.mark.parametrize("text, want", [("a:\n  b: 1\nc: 2", [(1, (), "a", ""), (2, ("a",), "b", "1"), (3, (), "c", "2")]), ("a:\n- x\n- y: 1\n  z: 2\nb:", [(2, ("a",), None, "x"), (3, ("a",), "y", "1"), (4, ("a",), "z", "2"), (5, (), "b", "")]), ("'k: 1': \"v # no\" # c", [(1, (), "k: 1", "v # no")])])
def test_yaml(text, want):
    assert [x for x in D.yaml_lines(text.split("\n")) if x in want or x[2] not in ("a",)][-len(want) :] == want
