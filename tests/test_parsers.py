"""Parsers of sources and descriptions."""

import json

import pytest

from quillgraph.parse.parser import parse_source
from quillgraph.parse.rules import Call, detect

GO = """package main
import "fmt"
// serve answers a request.
func serve(w http.Writer, r *http.Request) {
    fmt.Println("x // no comment")
    body(r)
}
func (s *S) Start(a, port int) (int, error) {
    return s.listen(port)
}
"""
PY = '''import os
@app.get("/products")
def lists(a: int, *b, c: str = "x") -> dict:
    """Lists all."""
    requests.post("https://api.example.com/x")
    producer.produce("orders", v)
    producer.produce("orders", w)
    producer.produce(topic, w)
    KafkaConsumer("inv", group_id="g")
class Shop(Base, other.Mixin):
    def buy(self): return gateway.go(1)
    async def sell(self, tx): await gateway.back(tx)
'''
TS = """/** Say hello. */
function hello(name: string, n?: number): string {
  return `Hi ${name}`;
}
const add = (a: number, b: number): number => a + b;
export class Calc extends Base implements Op {
  times(x: number): number {
    if (x) { return other.call(x); }
    return x;
  }
}
const r = await apiClient.get(`${B}/api/products`);
router.delete("/items/:id", h);
channel.sendToQueue("jobs", buf);
"""
JAVA = """public class Users extends Base implements A, B<C> {
  /**
   * Find one.
   */
  @Override
  public User find(String id, List<String> xs) {
    return repo.get(id);
  }
  public void remove(String id) throws Gone {
    repo.remove(id);
  }
  Users(int a) { init(); }
}
interface Repo {
  User get(String id);
}
"""
CS = """namespace A {
  public class Pay : IPay, Base<int> {
    /// <summary>Charge.</summary>
    public bool Charge(decimal amount, string cur) {
      return Gateway.Process(amount, cur);
    }
    public Pay() { Init(); }
  }
}
"""
DART = """/// Gets a user.
Future<User> getUser(String id, {bool cached = false}) async {
  return User.fromJson(await load(id));
}
abstract class Base extends W {}
class Home extends Base with Nav implements T {
  void _tap(String r) {
    FirebaseFirestore.instance.collection('users').doc(id).snapshots();
    navigate(r);
  }
}
"""
PHP = """<?php
/**
 * Total.
 */
function total(float $price, int $qty): float {
 return $price * $qty; # done
}
class Orders {
 public function make(string $n): void { $this->save($n); }
}
"""


def names(record):
    return [(s["name"], s["kind"], [(p["name"], p["type"]) for p in s["params"]], s["return_type"]) for s in record["symbols"]]


@pytest.mark.parametrize(
    ("path", "source", "expected"),
    [
        ("a.go", GO, [("serve", "function", [("w", "http.Writer"), ("r", "*http.Request")], None), ("Start", "method", [("a", "int"), ("port", "int")], "(int, error)")]),
        ("a.py", PY, [("lists", "function", [("a", "int"), ("b", None), ("c", "str")], "dict"), ("buy", "method", [("self", None)], None), ("sell", "method", [("self", None), ("tx", None)], None)]),
        ("a.ts", TS, [("hello", "function", [("name", "string"), ("n", "number")], "string"), ("add", "arrow_function", [("a", "number"), ("b", "number")], "number"), ("times", "method", [("x", "number")], "number")]),
        ("A.java", JAVA, [("find", "method", [("id", "String"), ("xs", "List<String>")], "User"), ("remove", "method", [("id", "String")], "void"), ("Users", "method", [("a", "int")], None), ("get", "method", [("id", "String")], "User")]),
        ("a.cs", CS, [("Charge", "method", [("amount", "decimal"), ("cur", "string")], "bool"), ("Pay", "method", [], None)]),
        ("a.dart", DART, [("getUser", "function", [("id", "String"), ("cached", "bool")], "Future<User>"), ("_tap", "method", [("r", "String")], "void")]),
        ("a.php", PHP, [("total", "function", [("$price", "float"), ("$qty", "int")], "float"), ("make", "method", [("$n", "string")], "void")]),
    ],
)
def test_symbols(path, source, expected):
    record = parse_source(path, source)
    assert record["errors"] == []
    assert names(record) == expected


def test_docstrings_calls_and_lines():
    go, py, java = parse_source("a.go", GO), parse_source("a.py", PY), parse_source("A.java", JAVA)
    assert go["symbols"][0]["docstring"] == "serve answers a request."
    assert [(c["name"], c["line"]) for c in go["symbols"][0]["calls"]] == [("fmt.Println", 5), ("body", 6)]
    assert py["symbols"][0]["docstring"] == "Lists all." and (py["symbols"][0]["start_line"], py["symbols"][0]["end_line"]) == (3, 9)
    assert java["symbols"][0]["docstring"] == "Find one."


def test_classes():
    found = lambda path, source: {c["name"]: (c["bases"], c["methods"]) for c in parse_source(path, source)["classes"]}
    assert found("a.py", PY) == {"Shop": (["Base", "other.Mixin"], ["buy", "sell"])}
    assert found("a.ts", TS) == {"Calc": (["Base", "Op"], ["times"])}
    assert found("A.java", JAVA) == {"Users": (["Base", "A", "B<C>"], ["find", "remove", "Users"]), "Repo": ([], ["get"])}
    assert found("a.cs", CS) == {"Pay": (["IPay", "Base<int>"], ["Charge", "Pay"])}
    assert found("a.dart", DART) == {"Base": (["W"], []), "Home": (["Base", "Nav", "T"], ["_tap"])}
    assert found("a.go", GO) == {} and found("a.php", PHP) == {}


def test_infrastructure():
    found = lambda path, source: [(i["kind"], i["target"], (i["metadata"] or {}).get("method")) for i in parse_source(path, source)["infra"]]
    assert set(found("a.py", PY)) == {("http_route_define", "/products", "GET"), ("http_request", "https://api.example.com/x", "POST"), ("kafka_produce", "orders", None), ("kafka_produce", "$topic", None), ("kafka_consume", "inv", None)}
    assert set(found("a.ts", TS)) == {("http_request", "/api/products", "GET"), ("http_route_define", "/items/:id", "DELETE"), ("rabbitmq_publish", "jobs", None)}
    assert ("firebase_firestore", "users", None) in found("a.dart", DART) and ("firebase_firestore", "firestore", None) in found("a.dart", DART)
    assert found("A.java", JAVA) == []


def test_first_rule_decides_and_equal_targets_are_one():
    calls = [Call("router.get", 1, ["/a"]), Call("self.client.get", 2, ["/b"]), Call("c.consume", 3, [], {"topic": "t", "group_id": "g"}), Call("router.get", 9, ["/a"])]
    assert [(p["kind"], p["target"], p["line"], p["metadata"]) for p in detect(calls)] == [("http_route_define", "/a", 1, {"method": "GET"}), ("firebase_firestore", "firestore", 2, None), ("kafka_consume", "t", 3, {"group_id": "g"})]


def test_errors_are_reported():
    assert parse_source("a.py", "def (:")["errors"] and parse_source("a.xyz", "")["errors"] and parse_source("a.ts", "class A {")["errors"]
    assert parse_source("a.py", None)["symbols"] == []


def test_openapi():
    doc = {"openapi": "3.0.0", "paths": {"/a": {"get": {"operationId": "listA", "tags": ["x", "y"]}, "post": {"summary": "make"}, "parameters": []}, "/a/{id}": {"delete": {}}}}
    record = parse_source("svc/openapi.json", json.dumps(doc))
    assert [(i["target"], i["metadata"]["method"], i["line"]) for i in record["infra"]] == [("/a", "GET", 1), ("/a", "POST", 2), ("/a/{id}", "DELETE", 3)]
    assert record["infra"][0]["metadata"] == {"method": "GET", "operationId": "listA", "tags": "x,y", "source": "openapi_spec"}
    old = parse_source("swagger.yaml", "swagger: '2.0'\nbasePath: /v1\npaths:\n  /b:\n    get: {}\n")
    assert old["infra"][0]["target"] == "/v1/b"
    assert parse_source("api.json", "{")["errors"] and parse_source("api.yaml", "a: 1")["errors"]


def test_compose():
    text = "services:\n  web:\n    build: .\n    ports: ['8080:80', {published: 9, target: 1}]\n    depends_on: [db]\n  db:\n    image: pg:1\n    networks: {n: {}}\n  bad: 3\n"
    found = {i["target"]: i["metadata"] for i in parse_source("docker-compose.dev.yml", text)["infra"]}
    assert found == {"web": {"image": "<local-build>", "ports": "8080,9", "dependsOn": "db", "networks": "", "source": "docker_compose"}, "db": {"image": "pg:1", "ports": "", "dependsOn": "", "networks": "n", "source": "docker_compose"}}
    assert parse_source("docker-compose.yml", "a: [")["errors"]


def test_workflow():
    text = "daily:\n  schedule_interval: '@daily'\n  default_args: {owner: me}\n  concurrency: 2\n  tasks:\n    one: {operator: a.b.PythonOperator, python_callable_name: f, retries: 1}\n    two: {dependencies: [one], op_kwargs: {a: 1}}\nnope: 3\n"
    dag, = parse_source("flows.yml", text)["dags"]
    assert (dag["name"], dag["schedule"], dag["owner"], dag["concurrency"]) == ("daily", "@daily", "me", 2)
    assert [(t["name"], t["operator"], t["dependencies"], t["op_kwargs"]) for t in dag["tasks"]] == [("one", "a.b.PythonOperator", [], None), ("two", "unknown", ["one"], '{"a": 1}')]
    assert parse_source("a.yml", "- 1")["errors"]
