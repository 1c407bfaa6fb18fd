"""A child process per task slot that runs scripts under limits it cannot lift.

The child is forked once and takes one script after another.  Its address space may grow
by ``max_memory_mb`` and not further: the kernel refuses more, and that is what counts as
exit 137, whatever the runner says of it.  The parent waits a little longer than
``max_duration_sec`` and then kills the child, which no script can ignore.  After any
outcome but a clean one the next script gets a new child.

This limits memory and time.  It is no jail: files and network are the runner's duty.
"""

from __future__ import annotations

import os
import pickle
import resource
import select
import signal
import time
from collections.abc import Callable

#: Seconds beyond the time limit in which a script may still end by itself.
GRACE = 0.25
_HEAD = 8


def _send(fd: int, value: object) -> None:
    data = pickle.dumps(value)
    data = memoryview(len(data).to_bytes(_HEAD, "little") + data)
    while data:
        data = data[os.write(fd, data) :]


def _receive(fd: int, until: float | None = None) -> object:
    """One value; EOFError if the other side is gone, TimeoutError after ``until``."""

    def take(n: int) -> bytes:
        data = b""
        while len(data) < n:
            if until is not None and not select.select([fd], [], [], max(0.0, until - time.monotonic()))[0]:
                raise TimeoutError
            part = os.read(fd, min(1 << 20, n - len(data)))
            if not part:
                raise EOFError
            data += part
        return data

    return pickle.loads(take(int.from_bytes(take(_HEAD), "little")))


def _address_space() -> int:
    """Bytes of address space this process has."""
    with open("/proc/self/statm") as file:
        return int(file.read().split()[0]) * resource.getpagesize()


class Slot:
    """Runs ``call(script, limits)`` in a child; ``call`` returns a dict with an
    ``error_class`` if the script failed."""

    def __init__(self, call: Callable[[str, dict], dict], max_memory_mb: float | None):
        self.call, self.max_memory_mb = call, max_memory_mb
        self.pid: int | None = None

    def _start(self) -> None:
        to_child, from_child = os.pipe(), os.pipe()
        pid = os.fork()
        if pid == 0:
            try:
                os.close(to_child[1])
                os.close(from_child[0])
                os.setpgid(0, 0)  # what the script starts is killed with it
                self._serve(to_child[0], from_child[1])
            finally:
                os._exit(0)
        os.close(to_child[0])
        os.close(from_child[1])
        self.pid, self.write, self.read = pid, to_child[1], from_child[0]

    def _serve(self, read: int, write: int) -> None:
        """The child: runs scripts until the parent closes the pipe."""
        if self.max_memory_mb:
            bound = _address_space() + int(self.max_memory_mb * (1 << 20))
            resource.setrlimit(resource.RLIMIT_AS, (bound, bound))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
        while True:
            try:
                script, limits = _receive(read)
            except EOFError:
                return
            try:
                outcome = self.call(script, limits)
            except MemoryError:  # not even the report found room
                outcome = {"error_class": "memory", "message": "out of memory", "traceback": None}
            _send(write, outcome)

    def stop(self) -> int | None:
        """End the child and all it started; its wait status."""
        if self.pid is None:
            return None
        for kill in (os.killpg, os.kill):
            try:
                kill(self.pid, signal.SIGKILL)
            except (ProcessLookupError, PermissionError):
                pass
        os.close(self.write)
        os.close(self.read)
        status = os.waitpid(self.pid, 0)[1]
        self.pid = None
        return status

    def run(self, script: str, limits: dict) -> dict:
        if self.pid is None:
            self._start()
        seconds = limits.get("max_duration_sec")
        until = None if not seconds else time.monotonic() + seconds + GRACE
        try:
            _send(self.write, (script, limits))
            outcome = _receive(self.read, until)
        except TimeoutError:
            self.stop()
            return {"error_class": "timeout", "message": "Execution timed out", "traceback": None}
        except (EOFError, BrokenPipeError):
            return self._died()
        if outcome.get("error_class") is not None or outcome.get("exit_code"):
            self.stop()
        return outcome

    def _died(self) -> dict:
        """What the end of the child says: it left, or something killed it."""
        # it may be dying still; its own status must not be taken for the kill in stop()
        for _ in range(200):
            pid, status = os.waitpid(self.pid, os.WNOHANG)
            if pid:
                break
            time.sleep(0.01)
        else:
            status = self.stop()
        if self.pid is not None:
            os.close(self.write)
            os.close(self.read)
            self.pid = None
        code = os.waitstatus_to_exitcode(status)
        if code == -signal.SIGKILL:
            return {"error_class": "memory", "message": "Memory limit exceeded (OOM)", "traceback": None}
        code = 128 - code if code < 0 else code
        return {"exit_code": code, "error_class": "runtime", "message": f"exit code {code}", "traceback": None}
