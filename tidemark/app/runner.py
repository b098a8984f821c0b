"""A runner of dependent stages that skips what hasn't changed and records what it did."""

from __future__ import annotations

import datetime
import hashlib
import json
import time
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path


def digest(x) -> str:
    """Of a JSON value, or of a local file's bytes: sixteen hex digits."""
    raw = x.read_bytes() if isinstance(x, Path) else json.dumps(x, sort_keys=True, default=str).encode()
    return hashlib.sha256(raw).hexdigest()[:16]


@dataclass
class StageRecord:
    name: str
    status: str
    inputs: str
    seconds: float = 0.0
    outputs: list[str] = field(default_factory=list)
    error: str | None = None

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Stage:
    """run(params, outputs of what it requires) returns paths of what it wrote."""

    run: Callable[[dict, dict[str, list[str]]], list[str]]
    requires: tuple[str, ...] = ()


class PipelineRunner:
    """Stages in the order of their requirements. One is skipped if its parameters and its inputs are those of its last good run
    and its outputs are there; parameters of False switch it off. A failure is recorded and then raised."""

    def __init__(self, stages: Mapping[str, Stage], folder: str, exists: Callable[[str], bool] = lambda p: Path(p).exists()):
        self.stages, self.folder, self.exists = dict(stages), Path(folder), exists

    def order(self, wanted: list[str] | None = None) -> list[str]:
        """ValueError for an unknown stage or a circle."""
        out: list[str] = []
        open_: set[str] = set()

        def visit(name: str) -> None:
            if name in out:
                return
            if name not in self.stages:
                raise ValueError(f"unknown stage {name}")
            if name in open_:
                raise ValueError(f"stage {name} requires itself")
            open_.add(name)
            for r in self.stages[name].requires:
                visit(r)
            open_.discard(name)
            out.append(name)

        for name in wanted or list(self.stages):
            visit(name)
        return out

    def _last(self) -> dict[str, dict]:
        path = self.folder / "manifest.json"
        return {r["name"]: r for r in json.loads(path.read_text())["stages"]} if path.exists() else {}

    def _write(self, run_id: str, records: list[StageRecord]) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        known = self._last() | {r.name: r.as_dict() for r in records}
        beside = self.folder / "manifest.json.part"
        beside.write_text(json.dumps({"run_id": run_id, "stages": list(known.values())}, indent=2))
        beside.replace(self.folder / "manifest.json")

    def run(self, params: Mapping[str, dict | bool] | None = None, wanted: list[str] | None = None, force: bool = False) -> list[StageRecord]:
        params = dict(params or {})
        run_id = f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%dT%H%M%S}-{digest(params)[:6]}"
        last, records, outputs = self._last(), [], {}
        for name in self.order(wanted):
            stage, mine = self.stages[name], params.get(name, {})
            given = {r: outputs.get(r, []) for r in stage.requires}
            inputs = digest({"params": mine, "inputs": {r: [p, [x.inputs for x in records if x.name == r]] for r, p in given.items()}})
            if mine is False:
                records.append(StageRecord(name, "disabled", inputs))
                continue
            before = last.get(name)
            if not force and before and before["status"] in ("done", "skipped") and before["inputs"] == inputs and all(map(self.exists, before["outputs"])):
                outputs[name] = before["outputs"]
                records.append(StageRecord(name, "skipped", inputs, 0.0, before["outputs"]))
                continue
            began = time.time()
            try:
                outputs[name] = list(stage.run(dict(mine or {}), given))
            except Exception as e:
                records.append(StageRecord(name, "failed", inputs, time.time() - began, [], f"{type(e).__name__}: {e}"))
                self._write(run_id, records)
                raise
            records.append(StageRecord(name, "done", inputs, round(time.time() - began, 3), outputs[name]))
        self._write(run_id, records)
        return records
