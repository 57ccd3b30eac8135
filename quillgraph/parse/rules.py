"""Infrastructure patterns: which calls touch topics, databases, endpoints, queues."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Call:
    """A call: callee text, line from 1, decoded positional and keyword arguments (None: no literal or name)."""

    name: str
    line: int
    args: list[str | None] = field(default_factory=list)
    kwargs: dict[str, str | None] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    pattern: str
    kind: str
    target: int | str | None
    fallback: str
    detail: str
    keys: tuple[str, ...] = ()


#: Fixed values, in order: the first rule whose pattern is found in the callee decides.
RULES = [
    Rule(r"\.produce$|\.send_async$|\.batch_produce$|MessageProducer", "kafka_produce", 0, "<topic>", "Produces to Kafka topic: {target}"),
    Rule(r"KafkaProducer$", "kafka_produce", None, "<kafka>", "Creates Kafka producer"),
    Rule(r"\.consume_batch$|\.sequential_consume$|MessageConsumer\.from_config|\.consume$|consume_cdc_messages", "kafka_consume", "topic", "<topic>", "Consumes from Kafka topic: {target}", ("group_id",)),
    Rule(r"KafkaConsumer$", "kafka_consume", 0, "<kafka>", "Creates Kafka consumer for: {target}", ("group_id",)),
    Rule(r"psycopg2\.connect$|PostgresHook$", "db_postgres", "postgres_conn_id", "postgres", "Connects to PostgreSQL: {target}"),
    Rule(r"execute_values$|\.execute$|\.executemany$", "db_postgres", None, "postgres", "Executes SQL on PostgreSQL"),
    Rule(r"MongoHook$", "db_mongo", "conn_id", "mongo", "Connects to MongoDB: {target}"),
    Rule(r"\.insert_many$|\.insert_one$|\.find$|\.update_many$|\.aggregate$", "db_mongo", "mongo_collection", "mongo", "MongoDB operation on: {target}"),
    Rule(r"^Elastic$|Elasticsearch$", "db_elasticsearch", "index", "elasticsearch", "Connects to Elasticsearch index: {target}"),
    Rule(r"helpers\.bulk$|\.search$|\.get_pit$|\.index$", "db_elasticsearch", None, "elasticsearch", "Elasticsearch operation: {target}"),
    Rule(r"requests\.post$|requests\.get$|requests\.put$|requests\.patch$|requests\.delete$", "http_request", 0, "<url>", "HTTP request to: {target}"),
    Rule(r"^(app|router|server|fastify|route)\.(get|post|put|patch|delete|use|all)$", "http_route_define", 0, "<path>", "Exposes route: {target}"),
    Rule(r"^(app|router|blueprint|api|bp)\.(get|post|put|patch|delete|route)$", "http_route_define", 0, "<path>", "FastAPI/Flask route: {target}"),
    Rule(r"^(Get|Post|Put|Patch|Delete|All|Controller|Head|Options)$", "http_route_define", 0, "<path>", "NestJS route: {target}"),
    Rule(r"^(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)$", "http_route_define", 0, "<path>", "Spring route: {target}"),
    Rule(r"^Route\.(get|post|put|patch|delete|any|match)$", "http_route_define", 0, "<path>", "Laravel route: {target}"),
    Rule(r"^(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route)$", "http_route_define", 0, "<path>", "ASP.NET route: {target}"),
    Rule(r"^fetch$", "http_request", 0, "<url>", "fetch to: {target}"),
    Rule(r"^axios\.(get|post|put|patch|delete|request|head|options)$", "http_request", 0, "<url>", "axios HTTP call to: {target}"),
    Rule(r"^ky\.(get|post|put|patch|delete)$", "http_request", 0, "<url>", "ky HTTP call to: {target}"),
    Rule(r"^got\.(get|post|put|patch|delete)$", "http_request", 0, "<url>", "got HTTP call to: {target}"),
    Rule(r"^https?\.request$|^https?\.get$", "http_request", 0, "<url>", "Node.js HTTP request to: {target}"),
    Rule(r"^(this\.)?(\w+\.)?(get|post|put|patch|delete)$", "http_request", 0, "<url>", "HTTP call to: {target}"),
    Rule(r"stub\.\w+$|grpc\.insecure_channel$|pb2_grpc\.\w+Stub$", "grpc_call", 0, "<grpc-service>", "gRPC call to: {target}"),
    Rule(r"pb\.New\w+Client$|grpc\.Dial$", "grpc_call", 0, "<grpc-service>", "gRPC call to: {target}"),
    Rule(r"ManagedChannelBuilder$|stub\.\w+$|channel\.newCall$", "grpc_call", 0, "<grpc-service>", "gRPC call to: {target}"),
    Rule(r"new \w+Client$|new \w+ServiceClient$", "grpc_call", 0, "<grpc-service>", "gRPC call to: {target}"),
    Rule(r"^GrpcMethod$|^GrpcStreamMethod$", "grpc_serve", 0, "<grpc-method>", "gRPC handler for: {target}", ("service",)),
    Rule(r"\.RegisterXxx\w+Server$|pb\.Register\w+Server$", "grpc_serve", 0, "<grpc-service>", "gRPC server registers: {target}"),
    Rule(r"^GrpcService$|^GrpcGlobalServerInterceptor$", "grpc_serve", 0, "<grpc-service>", "gRPC service: {target}"),
    Rule(r"\.basic_publish$|channel\.publish$", "rabbitmq_publish", 1, "<routing-key>", "RabbitMQ publish to: {target}"),
    Rule(r"\.basic_consume$|channel\.consume$", "rabbitmq_consume", 0, "<queue>", "RabbitMQ consume from: {target}"),
    Rule(r"\.sendToQueue$", "rabbitmq_publish", 0, "<queue>", "RabbitMQ publish to: {target}"),
    Rule(r"redis\.publish$|r\.publish$|client\.publish$", "redis_publish", 0, "<channel>", "Redis publish to channel: {target}"),
    Rule(r"pubsub\.subscribe$|\.psubscribe$|redis\.subscribe$", "redis_subscribe", 0, "<channel>", "Redis subscribe to channel: {target}"),
    Rule(r"subscriber\.subscribe$|sub\.subscribe$", "redis_subscribe", 0, "<channel>", "Redis subscribe to channel: {target}"),
    Rule(r"\.send_message$|sqs\.send_message$", "sqs_send", 0, "<queue-url>", "SQS send to: {target}", ("QueueUrl",)),
    Rule(r"\.receive_message$|sqs\.receive_message$", "sqs_receive", 0, "<queue-url>", "SQS receive from: {target}", ("QueueUrl",)),
    Rule(r"new SendMessageCommand$|SQSClient\.send$", "sqs_send", 0, "<queue-url>", "SQS send: {target}"),
    Rule(r"new ReceiveMessageCommand$", "sqs_receive", 0, "<queue-url>", "SQS receive: {target}"),
    Rule(r"nc\.publish$|nats\.publish$|js\.publish$", "nats_publish", 0, "<subject>", "NATS publish to: {target}"),
    Rule(r"nc\.subscribe$|nats\.subscribe$|js\.subscribe$", "nats_subscribe", 0, "<subject>", "NATS subscribe to: {target}"),
    Rule(r"nc\.Publish$|conn\.Publish$", "nats_publish", 0, "<subject>", "NATS publish to: {target}"),
    Rule(r"nc\.Subscribe$|conn\.Subscribe$", "nats_subscribe", 0, "<subject>", "NATS subscribe to: {target}"),
    Rule(r"FirebaseFirestore\.instance$|FirebaseFirestore$", "firebase_firestore", None, "firestore", "Initializes Firestore instance"),
    Rule(r"\.collection$|\.collectionGroup$", "firebase_firestore", 0, "<collection>", "Firestore collection: {target}"),
    Rule(r"\.doc$|\.document$", "firebase_firestore", 0, "<doc>", "Firestore document: {target}"),
    Rule(r"\.snapshots$|\.get$|\.set$|\.update$|\.delete$", "firebase_firestore", None, "firestore", "Firestore operation: {target}"),
    Rule(r"FirebaseAuth\.instance$|FirebaseAuth$", "firebase_auth", None, "firebase_auth", "Initializes Firebase Auth"),
    Rule(r"\.signInWithEmailAndPassword$|\.createUserWithEmailAndPassword$|\.signInAnonymously$|\.signInWithCredential$|\.signInWithPopup$|\.signOut$", "firebase_auth", None, "auth", "Firebase Auth operation: {target}"),
    Rule(r"FirebaseStorage\.instance$|FirebaseStorage$", "firebase_storage", None, "firebase_storage", "Initializes Firebase Storage"),
    Rule(r"\.putFile$|\.putData$|\.putString$|\.getDownloadURL$", "firebase_storage", None, "storage", "Firebase Storage operation: {target}"),
    Rule(r"FirebaseMessaging\.instance$|FirebaseMessaging$", "firebase_messaging", None, "fcm", "Initializes Firebase Messaging (FCM)"),
    Rule(r"\.getToken$|\.subscribeToTopic$|\.unsubscribeFromTopic$|FirebaseMessaging\.onMessage$|FirebaseMessaging\.onBackgroundMessage$", "firebase_messaging", None, "fcm", "FCM operation: {target}"),
    Rule(r"FirebaseDatabase\.instance$|FirebaseDatabase$", "firebase_realtime_db", None, "realtime_db", "Initializes Firebase Realtime Database"),
    Rule(r"DatabaseReference$|\.onValue$|\.onChildAdded$", "firebase_realtime_db", None, "realtime_db", "Realtime DB operation: {target}"),
    Rule(r"FirebaseCrashlytics\.instance$|FirebaseCrashlytics$", "firebase_crashlytics", None, "crashlytics", "Initializes Firebase Crashlytics"),
    Rule(r"\.recordError$|\.recordFlutterFatalError$|\.log$", "firebase_crashlytics", None, "crashlytics", "Crashlytics report: {target}"),
    Rule(r"FirebaseAnalytics\.instance$|FirebaseAnalytics$", "firebase_analytics", None, "analytics", "Initializes Firebase Analytics"),
    Rule(r"\.logEvent$|\.setUserId$|\.setCurrentScreen$", "firebase_analytics", 0, "<event>", "Analytics event: {target}"),
]
#: Patterns of Dart's method chains, and identifiers that stand for a service.
DART_RULES = [
    Rule(r"\.collection$|\.collectionGroup$", "firebase_firestore", 0, "<collection>", "Firestore collection: {target}"),
    Rule(r"\.doc$|\.document$", "firebase_firestore", 0, "<doc>", "Firestore document: {target}"),
    Rule(r"\.snapshots$|\.get$|\.set$|\.update$|\.delete$", "firebase_firestore", None, "firestore", "Firestore operation: {target}"),
    Rule(r"\.signInWithEmailAndPassword$|\.createUserWithEmailAndPassword$|\.signInAnonymously$|\.signOut$", "firebase_auth", None, "auth", "Firebase Auth operation: {target}"),
    Rule(r"\.putFile$|\.putData$|\.putString$|\.getDownloadURL$", "firebase_storage", None, "storage", "Firebase Storage operation: {target}"),
    Rule(r"\.getToken$|\.subscribeToTopic$|\.unsubscribeFromTopic$", "firebase_messaging", None, "fcm", "FCM operation: {target}"),
    Rule(r"\.recordError$", "firebase_crashlytics", None, "crashlytics", "Crashlytics report: {target}"),
    Rule(r"\.logEvent$|\.setUserId$|\.setCurrentScreen$", "firebase_analytics", 0, "<event>", "Analytics event: {target}"),
]
DART_NAMES = {
    "FirebaseFirestore": ("firebase_firestore", "firestore", "Initializes Firestore instance"),
    "FirebaseAuth": ("firebase_auth", "firebase_auth", "Initializes Firebase Auth"),
    "FirebaseStorage": ("firebase_storage", "firebase_storage", "Initializes Firebase Storage"),
    "FirebaseMessaging": ("firebase_messaging", "fcm", "Initializes Firebase Messaging (FCM)"),
    "FirebaseDatabase": ("firebase_realtime_db", "realtime_db", "Initializes Firebase Realtime Database"),
    "FirebaseCrashlytics": ("firebase_crashlytics", "crashlytics", "Initializes Firebase Crashlytics"),
    "FirebaseAnalytics": ("firebase_analytics", "analytics", "Initializes Firebase Analytics"),
    "DatabaseReference": ("firebase_realtime_db", "realtime_db", "Realtime DB reference"),
    "onValue": ("firebase_realtime_db", "realtime_db", "Realtime DB stream: onValue"),
    "onChildAdded": ("firebase_realtime_db", "realtime_db", "Realtime DB stream: onChildAdded"),
    "recordFlutterFatalError": ("firebase_crashlytics", "crashlytics", "Crashlytics: Flutter fatal error handler"),
}
HTTP_METHODS = {"GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "ALL", "USE"}


def _first(rules: list[Rule], callee: str) -> Rule | None:
    return next((r for r in rules if re.search(r.pattern, callee)), None)


def _found(rule: Rule, target: str, line: int, metadata: dict[str, str]) -> dict:
    return {"kind": rule.kind, "target": target, "detail": rule.detail.replace("{target}", target), "line": line, "metadata": metadata or None}


def detect(calls: list[Call]) -> list[dict]:
    """Patterns of the calls, in order; equal kind and target kept once."""
    out = []
    for call in calls:
        if rule := _first(RULES, call.name):
            given = call.args[rule.target] if isinstance(rule.target, int) and rule.target < len(call.args) else call.kwargs.get(rule.target) if isinstance(rule.target, str) else None
            metadata = {k: v for k in rule.keys if (v := call.kwargs.get(k))}
            method = call.name.split(".")[-1].upper()
            if rule.kind in ("http_route_define", "http_request") and method in HTTP_METHODS:
                metadata["method"] = method
            out.append(_found(rule, given or rule.fallback, call.line, metadata))
    return distinct(out)


def detect_dart(calls: list[Call], names: list[tuple[str, int]]) -> list[dict]:
    """Patterns of method chains, then of identifiers (one a kind and line)."""
    out = []
    for call in calls:
        if rule := _first(DART_RULES, call.name):
            named = call.args[0] if rule.target == 0 and call.args else None if rule.target == 0 else call.name.rsplit(".", 1)[-1]
            out.append(_found(rule, named or rule.fallback, call.line, {}))
    seen = set()
    for name, line in names:
        if name in DART_NAMES and (DART_NAMES[name][0], line) not in seen:
            kind, target, detail = DART_NAMES[name]
            seen.add((kind, line))
            out.append({"kind": kind, "target": target, "detail": detail, "line": line, "metadata": None})
    return distinct(out)


def distinct(patterns: list[dict]) -> list[dict]:
    first: dict[tuple[str, str], dict] = {}
    for p in patterns:
        first.setdefault((p["kind"], p["target"]), p)
    return list(first.values())
