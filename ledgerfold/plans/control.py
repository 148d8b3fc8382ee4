"""The control plane: phases, idempotent steps, cutover, repeated failures."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.sources.shared import shared_folder

PHASES = ("setup", "schema", "copy", "indexes", "constraints", "catchup", "follow", "drain", "cutover", "complete")
REPEATS = 2
#: Attempts at a connection, and the first wait between two in seconds.
ATTEMPTS, FIRST_WAIT = 5, 0.1
#: Version of the state's form; ``MIGRATIONS[n]`` makes n + 1 of n.
FORM = 2
MIGRATIONS = {1: lambda state: state | {"failures": state.get("failures", []), "form": 2}}
KEPT = 10


class ControlError(RuntimeError):
    pass


def allowed(now: str, wanted: str) -> bool:
    """Phases go forward by exactly one; the same again is nothing."""
    return PHASES.index(wanted) - PHASES.index(now) in (0, 1)


def streak(failures: list[str]) -> int:
    """How often the last failure came in a row."""
    n = 0
    while n < len(failures) and failures[-1 - n] == failures[-1]:
        n += 1
    return n


def connection_lost(sqlstate: str | None) -> bool:
    """Whether an error is of the connection, so that trying again may help."""
    return bool(sqlstate) and (sqlstate.startswith("08") or sqlstate in ("57P01", "57P02", "57P03"))


def retry_waits(attempts: int = ATTEMPTS, first: float = FIRST_WAIT) -> list[float]:
    """Seconds to wait after each failed attempt."""
    return [first * 2**n for n in range(attempts)]


def with_retries(work, sqlstate_of, attempts: int = ATTEMPTS, sleep=time.sleep):
    """``work()``, again after errors of the connection, and of no others."""
    for wait in retry_waits(attempts - 1):
        try:
            return work()
        except Exception as e:
            if not connection_lost(sqlstate_of(e)):
                raise
            sleep(wait)
    return work()


class ControlStore:
    """A small JSON state in numbered files; every change creates the next one, which
    fails if another process did, and is then tried again on what that one left."""

    def __init__(self, folder: str, spark: SparkSession | None = None):
        self.files = shared_folder(folder, spark)

    def _latest(self) -> tuple[int, dict]:
        while names := [n for n in self.files.names() if n.startswith("control-")]:
            if (data := self.files.read(names[-1])) is not None:
                state = json.loads(data)
                while state.get("form", 1) < FORM:
                    state = MIGRATIONS[state.get("form", 1)](state)
                return int(names[-1][8:28]), state
        return 0, {"form": FORM, "phase": PHASES[0], "steps": {}, "end_position": None, "snapshot": None, "failures": []}

    def load(self) -> dict:
        return self._latest()[1]

    def _change(self, f) -> dict:
        while True:
            number, state = self._latest()
            f(state)
            if self.files.create(f"control-{number + 1:020d}.json", json.dumps(state, sort_keys=True).encode()):
                if number >= KEPT:
                    self.files.delete(f"control-{number + 1 - KEPT:020d}.json")
                return state

    def lock(self, owner: str) -> bool:
        """Whether this owner may run: the first who asks, until ``unlock``."""
        return self.files.create("run.lock", owner.encode()) or self.files.read("run.lock") == owner.encode()

    def unlock(self, owner: str) -> None:
        if self.files.read("run.lock") == owner.encode():
            self.files.delete("run.lock")

    def event(self, kind: str, **fields) -> None:
        """One line of the event log; events are files, in the order of their time."""
        at = time.time_ns()
        self.files.create(f"events/{at:020d}-{kind}.json", json.dumps({"at_ns": at, "event": kind} | fields, sort_keys=True).encode())

    def events(self) -> list[dict]:
        return [json.loads(self.files.read(f"events/{n}")) for n in self.files.names("events")]

    def report(self, name: str, content: dict) -> dict:
        """Write a report once; the first one stays."""
        self.files.create(f"{name}.json", json.dumps(content, sort_keys=True).encode())
        return json.loads(self.files.read(f"{name}.json"))

    def transition(self, phase: str) -> dict:
        def to(state):
            if not allowed(state["phase"], phase):
                raise ControlError(f"can not go from {state['phase']} to {phase}")
            state["phase"] = phase
        return self._change(to)

    def step(self, name: str, work) -> bool:
        """Do a step once: false if it was done before."""
        if name in self.load()["steps"]:
            return False
        work()
        self._change(lambda s: s["steps"].setdefault(name, True))
        return True

    def set_once(self, field: str, value) -> dict:
        """End position and snapshot never change once set."""
        def put(state):
            if state[field] not in (None, value):
                raise ControlError(f"{field} is already {state[field]}")
            state[field] = value
        return self._change(put)

    def reset_copy(self) -> dict:
        def back(state):
            if PHASES.index(state["phase"]) > PHASES.index("copy"):
                raise ControlError("the copy is finished and can not be reset")
            state.update(phase=PHASES[0], snapshot=None, steps={})
        return self._change(back)

    def record_failure(self, sqlstate: str | None, message: str) -> int:
        """How often this failure came in a row; callers stop at ``REPEATS``."""
        signature = sqlstate or hashlib.sha256(message.encode()).hexdigest()
        return streak(self._change(lambda s: s["failures"].append(signature))["failures"])


def cutover(control: ControlStore, end_position: int, drain, sequences, cleanup, report_path: str) -> dict:
    """End position, drain, sequences, clean-up, report; resumable after any of
    them.  ``drain(end)``, ``sequences()`` and ``cleanup()`` must be repeatable."""
    control.set_once("end_position", end_position)
    control.step("drain", lambda: drain(end_position))
    control.step("sequences", sequences)
    control.step("cleanup", cleanup)
    control.event("cutover", end_position=end_position)
    report = {"end_position": end_position, "steps": sorted(control.load()["steps"])}
    folder, _, name = report_path.rpartition("/")
    files = shared_folder(folder)
    files.create(name, json.dumps(report, sort_keys=True).encode())
    return report


def progress_of(stock: DataFrame, progress: DataFrame) -> DataFrame:
    """``name, total, done`` of everything there is to do; nothing done is 0."""
    return stock.join(progress, "name", "left").select("name", "total", F.coalesce("done", F.lit(0)).alias("done"))


def still_there(recorded: DataFrame, stock: DataFrame) -> DataFrame:
    """What was recorded of relations that still exist."""
    return recorded.join(stock, "name", "left_semi")


def status_counts(work: DataFrame) -> DataFrame:
    """``kind, done, total`` of parts, indexes and so on."""
    return work.groupBy("kind").agg(F.count_if("completed").alias("done"), F.count("*").alias("total"))


#: Bounds of the memory given to one worker.
LEAST_MEMORY, MOST_MEMORY = 64 << 20, 16 << 30


def work_memory(memory: int, workers: int) -> int:
    """Half of the memory, shared by the workers, within bounds."""
    return max(LEAST_MEMORY, min(MOST_MEMORY, memory // 2 // workers))


def tuning(memory: int, workers: int, cores: int) -> dict[str, str]:
    """Session settings for a bulk copy with so many workers."""
    each = work_memory(memory, workers)
    return {"spark.sql.shuffle.partitions": str(4 * cores), "spark.sql.files.maxPartitionBytes": str(min(each // 4, 512 << 20)),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(min(each // 8, 256 << 20))}


def apply_tuning(spark: SparkSession, control: ControlStore, settings: dict[str, str]) -> None:
    """Set and remember what was set before; a second time changes nothing more."""
    before = {k: spark.conf.get(k, None) for k in settings}
    control._change(lambda s: s.setdefault("tuned", before))
    for k, v in settings.items():
        spark.conf.set(k, v)


def revert_tuning(spark: SparkSession, control: ControlStore) -> None:
    for k, v in (control.load().get("tuned") or {}).items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    control._change(lambda s: s.pop("tuned", None))


def server_settings(spark: SparkSession) -> DataFrame:
    """``name, value`` of the session's settings."""
    return spark.createDataFrame(sorted(spark.conf.getAll.items()), "name string, value string")


def log_usage(spark: SparkSession, folder: str) -> DataFrame:
    """``files, bytes`` that a log folder holds."""
    from ledgerfold.sources.shared import list_files

    sizes = [n for _, n in list_files(folder)]
    return spark.createDataFrame([(len(sizes), sum(sizes))], "files bigint, bytes bigint")


def maintain(control: ControlStore, store, names: list[str]) -> list[str]:
    """Fold the deltas of each table into its files and refresh its statistics, as a
    step that is done once a table."""
    done = []
    for name in names:
        def work(name=name):
            base = store.manifest()
            store.commit(base, {name: store.compact(name, base)})
        if control.step(f"maintain {name}", work):
            done.append(name)
    return done


def recover_stale(control: ControlStore, store) -> list[str]:
    """After a run that was lost before its copy was finished: begin the copy anew and
    remove what no manifest names."""
    control.reset_copy()
    return store.sweep()


def source_fingerprint(source: str) -> str:
    return hashlib.sha256(source.encode()).hexdigest()


def generation_of(source: str, selection: str) -> str:
    """What progress belongs to: the source and what is selected of it."""
    return hashlib.sha256(f"{source}\n{selection}".encode()).hexdigest()


def stream_name(source: str) -> str:
    return source_fingerprint(source)[:16]


def status(control: ControlStore, manifest: dict, staged_lsn: int, form: str = "json") -> str:
    state = control.load()
    lines = {
        "phase": state["phase"], "steps": sorted(state["steps"]), "applied_lsn": manifest["remote_lsn"], "staged_lsn": staged_lsn,
        "lag_bytes": max(0, staged_lsn - manifest["remote_lsn"]), "tables": sorted(manifest["tables"])}
    return json.dumps(lines, sort_keys=True) if form == "json" else "\n".join(f"{k}: {v}" for k, v in lines.items())


def metrics(manifest: dict, staged_lsn: int) -> str:
    """The state in the text format that metric collectors read."""
    return "".join(
        f"# TYPE {name} gauge\n{name} {value}\n"
        for name, value in (("ledgerfold_applied_lsn", manifest["remote_lsn"]), ("ledgerfold_staged_lsn", staged_lsn),
                            ("ledgerfold_lag_bytes", max(0, staged_lsn - manifest["remote_lsn"])), ("ledgerfold_manifest_version", manifest["version"])))
