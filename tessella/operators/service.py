"""Task services: parameters and their checks, a registry, running a task, and a notice when it ends."""

from __future__ import annotations

import datetime
import json
import os
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from tessella.client.errors import retry
from tessella.operators.tasks import DONE, FAILED, RUNNING, WAITING

# Result codes and their meaning.
CODES = {0: "ok", 10000: "parameters are missing or wrong", 20000: "task is not known", 30000: "task failed", 40000: "not allowed", 50000: "storage failed", 60000: "unknown error"}
KINDS: dict[str, Callable[[Any], Any]] = {"INT": int, "FLOAT": float, "STRING": str, "FILE": str}


def envelope(code: int = 0, data: Any = None, message: str | None = None) -> dict[str, Any]:
    return {"errno": code, "errmsg": CODES[code] if message is None else message, "data": data}


@dataclass
class Argument:
    """A request parameter; files have a list of extensions."""

    name: str
    kind: str = "STRING"
    required: bool = True
    default: Any = None
    extensions: tuple[str, ...] = ()
    check: Callable[[Any], bool] | None = None

    def parse(self, values: dict[str, Any]) -> Any:
        if self.kind not in KINDS:
            raise ValueError(f"no parameter is of kind {self.kind}")
        raw = values.get(self.name)
        if raw is None:
            if self.required and self.default is None:
                raise ValueError(f"{self.name} is missing")
            return self.default
        try:
            value = KINDS[self.kind](raw)
        except (TypeError, ValueError):
            raise ValueError(f"{self.name} is not of kind {self.kind}") from None
        if self.kind == "FILE" and self.extensions and os.path.splitext(value)[1].lower().lstrip(".") not in {e.lower().lstrip(".") for e in self.extensions}:
            raise ValueError(f"{self.name} has another extension than {', '.join(self.extensions)}")
        if self.check and not self.check(value):
            raise ValueError(f"{self.name} is out of range")
        return value


def stored_name(name: str, now: datetime.datetime | None = None) -> str:
    """Name under which an uploaded file is kept."""
    return f"{(now or datetime.datetime.now()):%Y%m%d%H%M%S}_{os.path.basename(name)}"


@dataclass
class Service:
    """One kind of task: its parameters, and what does it."""

    task_type: str
    arguments: list[Argument]
    do_task: Callable[[int, dict[str, Any], Callable[[int], None]], tuple[bool, Any]]
    check: Callable[[dict[str, Any]], str | None] = lambda params: None
    set_up: Callable[[], None] = lambda: None

    def parse(self, values: dict[str, Any]) -> dict[str, Any]:
        params = {a.name: a.parse(values) for a in self.arguments}
        if wrong := self.check(params):
            raise ValueError(wrong)
        return params


@dataclass
class Throttle:
    """Lets a report pass if `gap` seconds went by since the last that passed."""

    gap: float = 0.5
    clock: Callable[[], float] = time.time
    last: float = float("-inf")

    def __call__(self) -> bool:
        now = self.clock()
        if now - self.last < self.gap:
            return False
        self.last = now
        return True


@dataclass
class Registry:
    """Services by task type, and tasks in memory; a stand-in for the table where one process runs a few tasks."""

    services: dict[str, Service] = field(default_factory=dict)
    tasks: dict[int, dict[str, Any]] = field(default_factory=dict)
    notify: Callable[[dict[str, Any]], None] | None = None

    def register(self, service: Service) -> None:
        if service.task_type in self.services:
            raise ValueError(f"{service.task_type} is registered already")
        self.services[service.task_type] = service

    def submit(self, task_type: str, values: dict[str, Any]) -> dict[str, Any]:
        if task_type not in self.services:
            return envelope(20000)
        try:
            params = self.services[task_type].parse(values)
        except ValueError as e:
            return envelope(10000, message=str(e))
        number = len(self.tasks) + 1
        self.tasks[number] = {"id": number, "tasktype": task_type, "inputparams": json.dumps(params, ensure_ascii=False), "outputparams": None, "status": WAITING, "progress": 0, "content": None}
        return envelope(data={"task_id": number})

    def run(self, number: int, throttle: Throttle | None = None) -> dict[str, Any]:
        """Run a waiting task; others are left as they are. A task stopped meanwhile keeps that state."""
        task = self.tasks[number]
        if task["status"] != WAITING:
            return task
        task["status"] = RUNNING
        passes = throttle or Throttle()

        def report(progress: int) -> None:
            if passes() and isinstance(progress, int) and 0 <= progress <= 100 and task["status"] == RUNNING:
                task["progress"] = progress

        try:
            ok, data = self.services[task["tasktype"]].do_task(number, json.loads(task["inputparams"]), report)
        except Exception as e:  # noqa: BLE001  a task's failure is its state
            ok, data = False, str(e)
        if task["status"] == RUNNING:
            task["status"] = DONE if ok else FAILED
            if ok:
                task |= {"progress": 100, "outputparams": json.dumps(data, ensure_ascii=False)}
            else:
                task["content"] = str(data)
        if self.notify:
            self.notify({"task_id": number, "status": task["status"], "data": data})
        return task

    def stop(self, number: int) -> dict[str, Any]:
        task = self.tasks.get(number)
        if task is None:
            return envelope(20000)
        if task["status"] in (DONE, FAILED):
            return envelope(40000)
        task["content"] = "Stopped Before Start" if task["status"] == WAITING else "Stopped"
        task["status"] = FAILED
        return envelope()

    def recover(self) -> list[int]:
        """Tasks that were waiting or running, set back to waiting, in order."""
        again = sorted(n for n, t in self.tasks.items() if t["status"] in (WAITING, RUNNING))
        for n in again:
            self.tasks[n] |= {"status": WAITING, "progress": 0}
        return again


def notifier(url: str, attempts: int = 1, wait: float = 5.0, post: Callable[[str, bytes], None] | None = None) -> Callable[[dict[str, Any]], None]:
    """Posts a payload as JSON, again after `wait` seconds if it fails; after the last attempt failures are dropped."""

    def send(target: str, body: bytes) -> None:
        request = urllib.request.Request(target, body, {"Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=10).close()

    def run(payload: dict[str, Any]) -> None:
        call = retry((OSError,), attempts, lambda attempt: wait)(post or send)
        try:
            call(url, json.dumps(payload, ensure_ascii=False).encode())
        except OSError:
            return

    return run
