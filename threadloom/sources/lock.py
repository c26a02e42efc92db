"""One writer at a time: an exclusive lock held by the driver."""

from __future__ import annotations

import fcntl
import os
import threading
import time
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import ClassVar

from py4j.protocol import Py4JError, Py4JJavaError


class LockHeldError(RuntimeError):
    """Another writer has the lock."""


class WriterLock:
    """Never waits. The file stays behind, as removing it would let two writers hold two files."""

    def __init__(self, path: str | os.PathLike):
        self.path, self._fd = Path(path), None

    def acquire(self) -> WriterLock:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        fd = os.open(self.path, os.O_CREAT | os.O_RDWR, 0o600)
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            os.close(fd)
            raise LockHeldError(f"another writer holds {self.path}") from e
        self._fd = fd
        return self

    def check(self) -> None:
        """The operating system keeps it for as long as the process lives."""

    def release(self) -> None:
        """Does nothing the second time."""
        if self._fd is not None:
            fcntl.flock(self._fd, fcntl.LOCK_UN)
            os.close(self._fd)
            self._fd = None

    __enter__ = acquire

    def __exit__(self, *_) -> None:
        self.release()


class LockLostError(LockHeldError):
    """Another writer took the lock over, as this one's lease had run out."""


class SharedLock:
    """A lease: a file on a shared file system that only one writer can create, and that it keeps fresh.

    A thread sets the file's time again every third of `lease` seconds. Of a driver that died the time grows
    old, and once it is older than the lease the next writer takes the file's place. `check` before each
    commit refuses a writer whose file isn't there any more (say, after a long pause). Clocks of drivers and the
    file system may differ by less than the lease.
    """

    held: ClassVar[dict[str, SharedLock]] = {}  # of this process, by path

    def __init__(self, fs, path, lease: float = 120.0, clock: Callable[[], float] = time.time):
        self.fs, self.path, self.lease, self.clock = fs, path, lease, clock
        self.owner = uuid.uuid4().hex
        self._stop: threading.Event | None = None

    def acquire(self) -> SharedLock:
        self.fs.mkdirs(self.path.getParent())
        if not self.fs.createNewFile(self.path):
            self._take_over()
        out = self.fs.create(self.path, True)
        out.write(bytearray(self.owner.encode()))
        out.close()
        self.fs.deleteOnExit(self.path)
        self._stop = threading.Event()
        threading.Thread(target=self._keep_fresh, args=(self._stop,), daemon=True).start()
        SharedLock.held[self.path.toString()] = self
        return self

    def _take_over(self) -> None:
        """Of several writers that find an old file only one can rename it."""
        refused = LockHeldError(f"another writer holds {self.path}")
        try:
            old = 1000 * (self.clock() - self.lease)
            if self.fs.getFileStatus(self.path).getModificationTime() > old:
                raise refused
            aside = self.path.suffix(f".{self.owner}")
            if not self.fs.rename(self.path, aside):
                raise refused
            if self.fs.getFileStatus(aside).getModificationTime() > old:  # a third one was faster, and it is its file
                self.fs.rename(aside, self.path)
                raise refused
            self.fs.delete(aside, False)
        except Py4JJavaError as e:  # it went in the meantime
            raise refused from e
        if not self.fs.createNewFile(self.path):
            raise refused

    def _keep_fresh(self, stop: threading.Event) -> None:
        while not stop.wait(self.lease / 3):
            try:
                if self._owner() == self.owner:
                    self.fs.setTimes(self.path, int(1000 * self.clock()), -1)
            except Py4JError:  # tried again in time, or the lease runs out
                continue

    def _owner(self) -> str:
        """What the file says, "" if there is none."""
        if not self.fs.exists(self.path):
            return ""
        stream = self.fs.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def check(self) -> None:
        """LockLostError if the lock isn't held any more."""
        if self._stop is None or self._owner() != self.owner:
            raise LockLostError(f"another writer took over {self.path}")

    def release(self) -> None:
        """Does nothing the second time."""
        if self._stop is not None:
            self._stop.set()
            self._stop = None
            SharedLock.held.pop(self.path.toString(), None)
            if self._owner() == self.owner:
                self.fs.delete(self.path, False)

    __enter__ = acquire

    def __exit__(self, *_) -> None:
        self.release()
