"""REST sources: a plan of bounded, read-only requests, and the observations of what they return.

Nothing here opens a connection. A plan is made from the source's TOML alone; acquiring hands each planned request to a
transport that the caller gives (a callable, or a folder of saved responses), checks the answers against the source's bounds and
redacts them before anything is kept. The responses of a run are few and bounded by `max_bytes_per_run`, so they come
as one small frame and are extracted like files.
"""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.functions import keys as K
from cairngraph.operators.base import redact_url, secret_name
from cairngraph.sources import repository
from cairngraph.sources.ingest import ALLOWED, PolicyRefused, annotated, redact_value

# What a source may ask for.
GITHUB_PATHS = {
    "/repos/{owner}/{repo}": "repository_metadata",
    "/repos/{owner}/{repo}/issues": "issues",
    "/repos/{owner}/{repo}/pulls": "pull_requests",
    "/repos/{owner}/{repo}/releases": "releases",
    "/repos/{owner}/{repo}/actions/runs": "actions",
}
CREDENTIAL_REFERENCES = ("local_secret_ref:", "os_keychain_ref:", "env_ref:")
#: Members of GitHub's answers that are hidden beside those under a secret name, and marks of urls that carry a secret.
GITHUB_HIDDEN = ("clone_url", "ssh_url", "git_url", "download_url", "archive_url", "tarball_url", "zipball_url", "patch_url", "diff_url", "logs_url", "artifacts_url")
SECRET_URL_MARKS = ("token=", "access_token=", "authorization=", "signature=", "sig=", "x-amz-signature=")
_OWNER, _REPOSITORY = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?"), re.compile(r"[A-Za-z0-9._-]+")


@dataclass(frozen=True)
class Endpoint:
    name: str
    path: str
    response_type: str = "json"
    max_page_size: int = 100
    pagination: str = "none"
    downstream_route: str = "config.json"
    data_class: str = ""
    saved_response: str = ""


@dataclass(frozen=True)
class Remote:
    """owner and repository: of a GitHub source, else empty."""

    source_id: str
    policy_status: str
    provider: str
    endpoints: tuple[Endpoint, ...]
    owner: str = ""
    repository: str = ""
    credentials_ref: str = ""
    max_requests_per_run: int = 10
    max_bytes_per_run: int = 10 << 20
    max_items_per_run: int = 1000
    retention_policy: str = "local_user_controlled"
    sensitivity: str = "private"


@dataclass(frozen=True)
class Answer:
    status: int
    body: bytes


Transport = Callable[[Mapping], Answer]


def read_remote(text: str) -> Remote:
    """A REST or GitHub source's TOML, checked: allowed and read-only, bounded, GET requests only, no secret in it."""
    try:
        t = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise PolicyRefused(f"not TOML: {e}") from e
    s, limits, github = (t.get(n) or {} for n in ("source", "limits", "github"))
    if not isinstance(s.get("source_id"), str) or not s["source_id"].strip():
        raise PolicyRefused("source.source_id is required")
    if s.get("policy_status") not in ALLOWED:
        raise PolicyRefused(f"policy {s.get('policy_status')} does not allow this source")
    if s.get("read_only") is not True or s.get("mutation_allowed", False):
        raise PolicyRefused("a source must be read-only")
    if s.get("consent_revoked"):
        raise PolicyRefused("consent was revoked")
    if any(secret_name(n) and n != "credentials_ref" for part in (s, limits, github) for n in part):
        raise PolicyRefused("a source holds no secrets")
    reference = s.get("credentials_ref", "")
    if reference and not reference.startswith(CREDENTIAL_REFERENCES):
        raise PolicyRefused("credentials are referred to, never written down")
    bounds = {n: limits[n] for n in ("max_requests_per_run", "max_bytes_per_run", "max_items_per_run") if n in limits}
    if any(not isinstance(v, int) or isinstance(v, bool) or v < 1 for v in bounds.values()):
        raise PolicyRefused("limits must be positive integers")
    owner, name = github.get("owner", ""), github.get("repository", "")
    if github and not (_OWNER.fullmatch(owner) and _REPOSITORY.fullmatch(name)):
        raise PolicyRefused("owner and repository are required")
    out = []
    for e in t.get("endpoints") or ():
        if str(e.get("method", "GET")).upper() != "GET":
            raise PolicyRefused(f"endpoint {e.get('name')} would change something")
        if not isinstance(e.get("path"), str) or not e["path"].startswith("/") or not e.get("name"):
            raise PolicyRefused("an endpoint needs a name and an absolute path")
        if github and e["path"] not in GITHUB_PATHS:
            raise PolicyRefused(f"path {e['path']} is not known")
        known = {n: e[n] for n in ("response_type", "max_page_size", "pagination", "downstream_route", "saved_response") if n in e}
        out.append(Endpoint(e["name"], e["path"], data_class=GITHUB_PATHS.get(e["path"], e.get("data_class", "")), **known))
    made = Remote(s["source_id"], s["policy_status"], s.get("provider", "github" if github else "rest"), tuple(out), owner, name, reference, **bounds,
                  retention_policy=t.get("retention", {}).get("policy", "local_user_controlled"), sensitivity=t.get("redaction", {}).get("sensitivity", "private"))
    if not out or len(out) > made.max_requests_per_run or len({e.name for e in out}) < len(out):
        raise PolicyRefused("endpoints must be named apart, and no more than max_requests_per_run")
    return made


def _sha(value: object) -> str:
    return hashlib.sha256(K.canonical_json(value).encode()).hexdigest()


def plan(r: Remote) -> dict:
    """The requests of a run, under ids that only the source decides; nothing is asked for yet."""
    fill = lambda path: path.replace("{owner}", r.owner).replace("{repo}", r.repository)
    requests = []
    for e in r.endpoints:
        body = {"source_id": r.source_id, "owner": r.owner, "repository": r.repository, "endpoint": asdict(e)}
        requests.append({"request_id": _sha(body)[:24], "endpoint_name": e.name, "method": "GET", "path": fill(e.path), "response_type": e.response_type, "downstream_route": e.downstream_route, "data_class": e.data_class, "saved_response": e.saved_response})
    run = f"api-{_sha({'source': asdict(r), 'requests': [x['request_id'] for x in requests]})[:24]}"
    body = {
        "source_id": r.source_id, "provider": r.provider, "policy_status": r.policy_status, "owner": r.owner, "repository": r.repository, "api_run_id": run,
        "api_manifest_id": hashlib.sha256(f"{r.source_id}:{run}".encode()).hexdigest()[:24], "requests": requests, "max_requests_per_run": r.max_requests_per_run, "max_bytes_per_run": r.max_bytes_per_run,
        "max_items_per_run": r.max_items_per_run, "retention_policy": r.retention_policy, "sensitivity": r.sensitivity,
    }
    return body | {"manifest_sha256": _sha(body)}


def saved_answers(folder: str) -> Transport:
    """Answers from files of a folder, by the endpoint's saved_response."""

    def fetch(request: Mapping) -> Answer:
        top = Path(folder).resolve()
        file = (top / request["saved_response"]).resolve()
        if not request["saved_response"] or not file.is_relative_to(top):
            raise PolicyRefused(f"endpoint {request['endpoint_name']} has no saved response")
        return Answer(200, file.read_bytes())

    return fetch


def redact_github(value: object, name: str | None = None) -> object:
    """GitHub's answers: bodies only measured, members under secret names and addresses of content hidden, urls with a secret hidden."""
    if name is not None and name.lower() == "body":
        body = "" if value is None else str(value)
        return {"body_present": bool(body), "body_length": len(body), "body_sha256": hashlib.sha256(body.encode()).hexdigest() if body else "", "body_redacted": True}
    hidden = lambda reason: {"redacted": True, "redaction_reason": reason, "literal_type": "string" if isinstance(value, str) else redact_value(value, "token")["literal_type"]}
    if name is not None and (secret_name(name) or any(h in name.lower().replace("-", "_") for h in GITHUB_HIDDEN)):
        return hidden("secret_key")
    if isinstance(value, str) and value.startswith("http") and any(m in value.lower() for m in SECRET_URL_MARKS):
        return hidden("sensitive_url")
    if isinstance(value, Mapping):
        return {str(k): redact_github(v, str(k)) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_github(v) for v in value]
    return redact_url(value) if isinstance(value, str) and "://" in value else value


def acquire(spark: SparkSession, r: Remote, transport: Transport, run_id: int = 1) -> tuple[dict, DataFrame]:
    """The run's manifest (with what came back) and its observations."""
    m = plan(r)
    kept, responses, size, items = [], [], 0, 0
    for request in m["requests"]:
        answer = transport(request)
        if not 200 <= answer.status < 300:
            raise PolicyRefused(f"endpoint {request['endpoint_name']} answered {answer.status}")
        size += len(answer.body)
        if size > r.max_bytes_per_run:
            raise PolicyRefused("responses exceed max_bytes_per_run")
        try:
            value = json.loads(answer.body)
        except ValueError as e:
            raise PolicyRefused(f"endpoint {request['endpoint_name']} answered no JSON") from e
        count = len(value) if isinstance(value, list) else 1
        items += count
        if items > r.max_items_per_run:
            raise PolicyRefused("responses exceed max_items_per_run")
        shown = K.canonical_json(redact_github(value) if r.owner else redact_value(value))
        path = f"api/{r.source_id}/{m['api_run_id']}/{request['endpoint_name']}.json"
        kept.append((path, bytearray(shown.encode()), False, request["request_id"], request["data_class"]))
        responses.append({"endpoint_name": request["endpoint_name"], "request_id": request["request_id"], "status": answer.status, "bytes": len(answer.body), "items": count, "redacted": shown != K.canonical_json(value), "sha256": hashlib.sha256(shown.encode()).hexdigest()})
    rows = spark.createDataFrame(kept, "path string, content binary, executable boolean, request_id string, data_class string")
    found = repository.observe(repository.classify(rows.select("path", "content", "executable")), run_id).join(rows.select("path", "request_id", "data_class"), "path")
    changed = F.col("path").isin(*(k[0] for k, x in zip(kept, responses, strict=True) if x["redacted"]))
    out = annotated(
        found, api_run_id=F.lit(m["api_run_id"]), api_manifest_id=F.lit(m["api_manifest_id"]), api_request_id=F.col("request_id"), api_data_class=F.nullif(F.col("data_class"), F.lit("")), source_id=F.lit(r.source_id),
        source_type=F.lit("api.rest"), api_provider=F.lit(r.provider), api_policy_status=F.lit(r.policy_status), github_owner=F.nullif(F.lit(r.owner), F.lit("")), github_repository=F.nullif(F.lit(r.repository), F.lit("")),
        redacted=F.when(changed, F.lit(True)),
    )
    return m | {"responses": responses, "total_bytes": size, "total_items": items}, out.select("run_id", "ordinal", *(c for c in found.columns if c not in ("run_id", "ordinal", "request_id", "data_class")))


def manifests(spark: SparkSession, glob: str) -> DataFrame:
    """The manifests of all files that match, as value (JSON text)."""
    return spark.read.text(glob, wholetext=True).where(F.get_json_object("value", "$.api_run_id").isNotNull())


def manifest_summary(found: DataFrame) -> DataFrame:
    """One row over manifests(value): sources, runs, requests, responses, items and bytes."""
    schema = "source_id string, api_run_id string, requests array<struct<request_id: string>>, responses array<struct<status: int, redacted: boolean>>, total_bytes bigint, total_items bigint"
    m = found.select(F.from_json("value", schema).alias("m")).select("m.*")
    size = lambda c: F.sum(F.greatest(F.size(c), F.lit(0)).cast("long"))
    return m.agg(
        F.count_distinct("source_id").alias("sources"), F.count_distinct("api_run_id").alias("runs"), size("requests").alias("requests"), size("responses").alias("responses"),
        size(F.filter("responses", lambda x: x["redacted"])).alias("redacted_responses"), F.sum("total_items").alias("total_items"), F.sum("total_bytes").alias("total_bytes"),
    )
