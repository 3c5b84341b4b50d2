"""Clients of remote procedures in small files."""

import pytest

from marlstone.operators import grpc
from marlstone.operators.code import Code

PROXY = """
export class PushJob {
  onModuleInit() { this.push = this.client.getService<PushService>('PushService'); // this.other = x.getService('No');
    const stats = client.getService<StatsService>(); }
  run() {
    this.push.sendPush({ a: 1 });
    stats.report(this.push);
    unknown.send("this.push.fake(");
    return this.deep.push.sendPush();
  }
}
"""
REGISTRY = """
const serviceRegistry = { [SERVICE_CARD]: { host: 'x', serviceName: 'CardSystemService' }, [OTHER]: { serviceName: 'Other' } };
module.exports = {
  Unlock: async function (data) {
    const { client } = createGrpcClientFromRegistry(SERVICE_CARD, 'Unlock');
    if (data) { return grpcClientCall(client, 'AdminUnlock', data); }
  },
  Plain: function (data) { return 1; },
  Missing: function () { createGrpcClientFromRegistry(NOWHERE); return grpcClientCall(c, 'X', d); },
};
"""
NET = """
class Net {
  static getUser = async (req) => { return this._net.getUser(req); };
  static rename = (req) => this._net.other(req);
  static batch = (req) => { this._net.batch(req); this._net.batch(req); };
  static plain = (req) => this._net.plain(req)
  instance = (req) => this._net.instance(req);
}
"""
PAGE = """
requestApi({ functionName: 'getUser', data: { a: [1, 2] } });
api.call(
  'x', {
  functionName: "plain" });
requestApi({ functionName: 'rename' });
requestApi({ functionName: 'getUser' + x });
requestApi({ functionName: name });
const o = { functionName: 'getUser' };
"""
CONNECT = """
class GrpcClientService {
  constructor() { this.client = createClient(Backend.Service, transport); this.plain = 3; }
  getClient(): Client { return this.client; }
  getPlain() { return this.plain; }
  getBoth() { log(); return this.client; }
}
"""
USER = """
svc.getClient().listUsers(req);
(svc.getClient() as any).castUsers(req);
svc.getPlain().notOne(req);
svc.getClient(1).withArgument(req);
const outer = svc.getClient();
function go(a) {
  outer.fromOuter();
  const outer2 = other();
  { const outer = plain(); outer.shadowed(); }
}
function hidden(outer) { outer.parameter(); }
"""


@pytest.fixture(scope="module")
def calls(spark):
    files = spark.createDataFrame([("r", "push.ts", PROXY), ("r", "reg.js", REGISTRY), ("r", "net.ts", NET), ("r", "page.ts", PAGE), ("r", "svc.ts", CONNECT), ("r", "user.ts", USER), ("q", "page.ts", PAGE), ("q", "user.ts", USER), ("r", "empty.ts", ""), ("r", "null.ts", None)], "repo_id string, file_path string, text string")
    return grpc.client_calls(files).collect(), files


def of(found, convention):
    return sorted((r.repo_id, r.file_path, r.line, r.service, r.method, r.input) for r in found if r.convention == convention)


def test_proxies(calls):
    assert of(calls[0], "proxy") == [("r", "push.ts", 6, "PushService", "sendPush", "grpc::PushService.sendpush"), ("r", "push.ts", 7, "StatsService", "report", "grpc::StatsService.report")]


def test_registry(calls):
    assert of(calls[0], "registry") == [("r", "reg.js", 4, "CardSystemService", "AdminUnlock", "grpc::CardSystemService.adminunlock")]


def test_dispatchers(calls):
    assert of(calls[0], "dispatcher") == [("r", "page.ts", 2, None, "getUser", "getUser"), ("r", "page.ts", 3, None, "plain", "plain")]


def test_getters_in_scope_order(calls):
    assert of(calls[0], "getter") == [("r", "user.ts", 2, None, "listUsers", "listUsers"), ("r", "user.ts", 3, None, "castUsers", "castUsers"), ("r", "user.ts", 8, None, "fromOuter", "fromOuter")]


def test_edges(spark, calls):
    ends = spark.createDataFrame([("n1", "grpc::PushService.sendpush"), ("n2", "grpc::A.getuser"), ("n3", "grpc::B.listusers"), ("n4", "grpc::C.listusers"), ("n5", "http::x")], "node_id string, identity_key string")
    got = sorted((r.method, r.kind, r.node_id) for r in grpc.invokes(calls[1], ends).collect())
    assert got == sorted([("sendPush", "unique", "n1"), ("report", "not_found", None), ("AdminUnlock", "not_found", None), ("getUser", "unique", "n2"), ("plain", "not_grpc", None), ("listUsers", "ambiguous", None), ("castUsers", "not_grpc", None), ("fromOuter", "not_grpc", None)])


def test_tokens():
    c = Code("a { b('}{', `x${y}`) // }\n /* { */ { c } }\n} d [ (")
    assert [t.text for t in c.tokens] == ["a", "{", "b", "(", "}{", ",", "x${y}", ")", "{", "c", "}", "}", "}", "d", "[", "("]
    assert [c.blocks(i) for i, t in enumerate(c.tokens) if t.text in ("a", "b", "c", "d")] == [[0], [1, 0], [2, 1, 0], [0]]
    assert c.tokens[9].line == 2 and c.tokens[13].line == 3 and c.end(15) == 15
    assert not Code("").tokens


def test_only_tokens_that_begin_a_rule_are_looked_at(monkeypatch):
    asked = []
    monkeypatch.setattr(Code, "is_", lambda self, at, *texts, whole=Code.is_: asked.append(at) or whole(self, at, *texts))
    assert grpc._facts_of("a = 'b' + 1;\n" * 1000) == []
    assert len(asked) <= 2 * 6000


def test_files_are_dealt_over_all_tasks(spark, sf, monkeypatch):
    """The table is one block of a file, and each row costs a pass of tokens."""
    from marlstone.plans import registry

    seen = []
    monkeypatch.setattr(grpc, "invokes", lambda files, ends, whole=grpc.invokes: seen.append(files) or whole(files, ends))
    registry.QUERIES["ext_grpc_client"](spark, sf)
    parts = seen[0].select("repo_id").rdd.glom().map(len).collect()
    assert len([n for n in parts if n]) >= 4
