"""Canonical text of open JSON, the ids of artifact documents, and pluggable identities of sources.

A document's id is its kind and the SHA-256 of its canonical text: keys sorted, minimal
separators, letters as they are. What the id covers differs by kind: all but the id itself,
or a list of keys. A key that is absent and a key that is null are different documents, so
documents stay open JSON until their id is known.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The field that holds the id of each kind of document, which the id does not cover.
OWN_ID = {"snap": "snapshot_id", "finding": "finding_id", "patch": "patch_id", "rew": "reward_id", "task": "task_id", "bundle": "bundle_id"}
# The keys that ids of the other kinds cover.
COVERED = {
    "episode": (
        "episode_version", "substrate_profile", "task_id", "reward_id", "subject", "trace_id", "outputs", "verification", "verification_evidence",
        "verifier_versions", "reward", "status", "validity", "replayability", "execution_facts",
    ),
    "env": ("environment_version", "substrate_profile", "subject", "tasks", "rewards", "profiles", "splits"),
}
# The keys of an event that a trace's id covers.
EVENT_KEYS = (
    "command", "cwd", "environment_keys", "exit_code", "stdout_digest", "stderr_digest", "files_created_digest", "files_modified_digest", "files_deleted_digest",
    "file_modes_changed_digest", "result_file_digest", "policy_violations_digest",
)
# The field of open JSON that must not name a derived id, whatever its depth.
IDENTITY_KEYS = ("env_id", "bundle_id", "snapshot_id", "task_id", "reward_id", "episode_id", "trace_id", "patch_id", "finding_id", "semantic_artifact_id")


def written(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def only(doc: dict, keys: tuple[str, ...]) -> dict:
    """The keys that are there; a null stays."""
    return {k: doc[k] for k in keys if k in doc}


def covered(kind: str, doc: dict) -> dict:
    """What the id of a document is made of."""
    if not isinstance(doc, dict):
        raise TypeError("no object")
    if kind == "trace":
        return {"trace_version": doc.get("trace_version"), "events": [only(e, EVENT_KEYS) for e in doc.get("events", [])]}
    if kind in COVERED:
        return only(doc, COVERED[kind])
    rest = {k: v for k, v in doc.items() if k != OWN_ID[kind]}
    if kind == "patch" and isinstance(rest.get("diff"), str):
        rest["diff"] = "\n".join("\n".join(rest["diff"].split("\r\n")).split("\r"))
    return rest


def submitted(doc: dict, version: str) -> dict:
    """The trace of a submission: a digest of the finding that arrived, and empty ones of all that did not happen."""
    if not isinstance(doc, dict):
        raise TypeError("no object")
    nothing, no_map = sha256(""), sha256("{}")
    finding = doc.get("finding")
    event: dict[str, Any] = dict.fromkeys(EVENT_KEYS, no_map)
    event |= {"command": [], "cwd": ".", "environment_keys": [], "exit_code": None, "stdout_digest": nothing, "stderr_digest": nothing}
    event |= {"result_file_digest": sha256(written({} if finding is None else finding)), "policy_violations_digest": sha256("[]")}
    return {"trace_version": version, "events": [event]}


def _over(make: Callable[[str | None, Any], str | None], bodies: Column, kinds: Column | str | None = None) -> Column:
    """make(kind, parsed body) for Arrow batches of JSON texts; null where a text is no JSON, or make refuses it."""

    @pandas_udf(T.StringType())
    def run(names: pd.Series, texts: pd.Series) -> pd.Series:
        def one(kind, body):
            try:
                return make(kind, json.loads(body))
            except (TypeError, ValueError, AttributeError, KeyError):
                return None

        return pd.Series([one(k, t) for k, t in zip(names, texts, strict=True)], dtype=object)

    return run(kinds if isinstance(kinds, Column) else F.lit(kinds).cast("string"), bodies)


def canonical_text(bodies: Column) -> Column:
    """JSON with sorted keys and minimal separators; null where the text is no JSON.

    Numbers, duplicate keys and escapes need a JSON reader's own rules, which Spark's
    typed and variant printers do not share; hence Arrow batches of Python.
    """
    return _over(lambda _, value: written(value), bodies)


def covered_text(kind: Column | str, bodies: Column) -> Column:
    """The canonical text of what an id of this kind covers; null where the text is no JSON object."""
    return _over(lambda kind, doc: written(covered(kind, doc)), bodies, kind)


def document_id(kind: Column | str, bodies: Column) -> Column:
    """The id of raw documents of a kind: snap, finding, patch, trace, rew, task, episode, env or bundle."""
    name = kind if isinstance(kind, Column) else F.lit(kind)
    return F.concat(name, F.lit("-"), F.sha2(covered_text(kind, bodies).cast("binary"), 256))


def submission_trace(bodies: Column, version: str) -> Column:
    """The canonical trace of raw submissions; null where one is no JSON object."""
    return _over(lambda _, doc: written(submitted(doc, version)), bodies)


def json_string(text: Column) -> Column:
    """A JSON string as the canonical text has it, without Python.

    Spark writes a control character's code in upper case, the canonical text in lower case.
    """
    quoted = F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]\z", 1)
    low = quoted
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.when(text.rlike(r"[\x00-\x1f]"), low).otherwise(quoted)


def json_array(texts: Column) -> Column:
    """A JSON array of strings, in the order given."""
    return F.concat(F.lit("["), F.array_join(F.transform(texts, json_string), ","), F.lit("]"))


def evidence_digest(signal: Column, state: Column, detail: Column, version: str) -> Column:
    """Digest of a verifier's evidence; `detail` is open JSON, none counts as an empty object."""
    body = F.coalesce(canonical_text(detail), F.lit("{}"))
    text = F.concat(F.lit('{"detail":'), body, F.lit(',"evidence_version":'), json_string(F.lit(version)), F.lit(',"signal":'), json_string(signal), F.lit(',"state":'), json_string(state), F.lit("}"))
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def lowered(text: Column, adapter: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """The identity of a source: its content id, or what a batch-wise adapter says."""
    if adapter is None:
        return F.concat(F.lit("task-"), F.sha2(text.cast("binary"), 256))
    return pandas_udf(adapter, "string")(text)
