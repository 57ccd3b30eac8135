"""Schemas and fixed vocabularies of the code-knowledge tables."""

from __future__ import annotations

SCHEMA_VERSION = "1.0"

#: File extension to language.
LANGUAGES = {
    ".go": "go", ".py": "python", ".php": "php", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".java": "java", ".cs": "csharp", ".dart": "dart", ".yml": "yaml", ".yaml": "yaml",
}
#: Directories that a scan skips.
SKIPPED_DIRECTORIES = ["node_modules", ".git", "vendor", "dist", "__pycache__", ".venv", "build"]

#: Kind of an infrastructure pattern -> (node label, edge type, broker or database type).
INFRA = {
    "kafka_produce": ("KafkaTopic", "PRODUCES_TO", None),
    "kafka_consume": ("KafkaTopic", "CONSUMES_FROM", None),
    "db_postgres": ("Database", "CONNECTS_TO", "postgresql"),
    "db_mongo": ("Database", "CONNECTS_TO", "mongodb"),
    "db_elasticsearch": ("Database", "CONNECTS_TO", "elasticsearch"),
    "http_request": ("HTTPEndpoint", "HTTP_CALL", None),
    "http_route_define": ("APIRoute", "EXPOSES", None),
    "grpc_call": ("GRPCEndpoint", "GRPC_CALL", None),
    "grpc_serve": ("GRPCEndpoint", "GRPC_HANDLES", None),
    "rabbitmq_publish": ("MessageQueue", "PUBLISHES_TO", "rabbitmq"),
    "rabbitmq_consume": ("MessageQueue", "CONSUMES_FROM", "rabbitmq"),
    "redis_publish": ("MessageChannel", "PUBLISHES_TO", "redis"),
    "redis_subscribe": ("MessageChannel", "SUBSCRIBES_TO", "redis"),
    "sqs_send": ("MessageQueue", "SENDS_TO", "sqs"),
    "sqs_receive": ("MessageQueue", "RECEIVES_FROM", "sqs"),
    "nats_publish": ("MessageChannel", "PUBLISHES_TO", "nats"),
    "nats_subscribe": ("MessageChannel", "SUBSCRIBES_TO", "nats"),
}
#: Fixed values: (mechanism, publishing edge, consuming edge, hub label) of the messaging linkage.
MECHANISMS = [
    ("rabbitmq", "PUBLISHES_TO", "CONSUMES_FROM", "MessageQueue"),
    ("redis", "PUBLISHES_TO", "SUBSCRIBES_TO", "MessageChannel"),
    ("sqs", "SENDS_TO", "RECEIVES_FROM", "MessageQueue"),
    ("nats", "PUBLISHES_TO", "SUBSCRIBES_TO", "MessageChannel"),
]

PARSED = (
    "file string, language string, "
    "symbols array<struct<name:string,kind:string,params:array<struct<name:string,type:string>>,return_type:string,docstring:string,calls:array<struct<name:string,line:int>>,start_line:int,end_line:int>>, "
    "classes array<struct<name:string,bases:array<string>,methods:array<string>,docstring:string,start_line:int,end_line:int>>, "
    "infra array<struct<kind:string,target:string,detail:string,line:int,metadata:map<string,string>>>, "
    "dags array<struct<name:string,schedule:string,description:string,owner:string,concurrency:double,tasks:array<struct<name:string,operator:string,callable_file:string,callable_name:string,bash_command:string,sql:string,conn_id:string,dependencies:array<string>,op_kwargs:string,retries:double,timeout_secs:double>>>>, "
    "errors array<string>"
)
