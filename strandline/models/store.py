"""Machines kept in files: a folder a version, with the arrays of the machine and a manifest that names the format, the kind,
the fields and a digest. Nothing in them is code.

    save(machine, "hdfs://.../promoters")             # version 1, 2, ...
    vector.decide(rows, load("hdfs://.../promoters"))  # executors read the newest version themselves

What load() gives holds no more than a path and a digest. Executors read the file when they first decide by it, check the
digest, and keep the machine for later tasks."""

from __future__ import annotations

import hashlib
import io
import json
from dataclasses import dataclass

import numpy as np
from pyarrow import fs

from strandline.config import Kernel
from strandline.files import read_bytes, resolved, write_bytes
from strandline.models.forest import Forest, Tree
from strandline.models.linear import Linear
from strandline.models.svm import Scaler, Svm, Vote
from strandline.models.validation import Sigmoid

FORMAT = 1
_TREE = ("feature", "split", "left", "right", "share")


def _svm(m: Svm, at: str = "") -> dict[str, np.ndarray]:
    numbers = np.array([m.rho, m.gamma, m.c0])
    return {f"{at}low": m.scaler.low, f"{at}high": m.scaler.high, f"{at}support": np.asarray(m.support), f"{at}coefficients": m.coefficients, f"{at}numbers": numbers, f"{at}kernel": np.array(m.kernel.value)}


def _svm_of(a: dict[str, np.ndarray], at: str = "") -> Svm:
    rho, gamma, c0 = a[f"{at}numbers"].tolist()
    return Svm(Scaler(a[f"{at}low"], a[f"{at}high"]), a[f"{at}support"], a[f"{at}coefficients"], rho, Kernel(str(a[f"{at}kernel"])), gamma, c0)


def arrays_of(machine) -> tuple[str, dict[str, np.ndarray]]:
    """(kind, arrays by name) of a machine."""
    if isinstance(machine, Svm):
        return "svm", _svm(machine)
    if isinstance(machine, Vote):
        out = {"classes": np.array(machine.classes, np.float64)}
        for i, m in enumerate(machine.machines):
            out |= _svm(m, f"{i}.")
        return "vote", out
    if isinstance(machine, Forest):  # trees end to end
        sizes = np.array([len(t.feature) for t in machine.trees], np.int64)
        return "forest", {"sizes": sizes, "oob_error": np.array(machine.oob_error)} | {c: np.concatenate([getattr(t, c) for t in machine.trees]) for c in _TREE}
    if isinstance(machine, Linear):
        return "linear", {"weights": machine.weights, "bias": np.array(machine.bias)}
    if isinstance(machine, Sigmoid):
        return "sigmoid", {"a": np.array(machine.a), "b": np.array(machine.b)}
    raise ValueError(f"there is no format for a {type(machine).__name__}")


def machine_of(kind: str, a: dict[str, np.ndarray]):
    if kind == "svm":
        return _svm_of(a)
    if kind == "vote":
        classes = tuple(a["classes"].tolist())
        return Vote(classes, tuple(_svm_of(a, f"{i}.") for i in range(len(classes) * (len(classes) - 1) // 2)))
    if kind == "forest":
        ends = np.cumsum(a["sizes"])[:-1]
        return Forest(tuple(Tree(*parts) for parts in zip(*(np.split(a[c], ends) for c in _TREE))), float(a["oob_error"]))
    if kind == "linear":
        return Linear(a["weights"], float(a["bias"]))
    if kind == "sigmoid":
        return Sigmoid(float(a["a"]), float(a["b"]))
    raise ValueError(f"unknown kind of machine: {kind}")


def versions(folder: str) -> list[int]:
    """Whole versions of a folder in order."""
    system, path = resolved(folder)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(int(f.path.split("/")[-2][1:]) for f in found if f.path.endswith("/manifest.json") and f.path.split("/")[-2][:1] == "v" and f.path.split("/")[-2][1:].isdigit())


def save(machine, folder: str) -> int:
    """Write the next version and return its number. The manifest comes last, so a version is whole or not there."""
    kind, arrays = arrays_of(machine)
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **arrays)
    data, number = buffer.getvalue(), max(versions(folder), default=0) + 1
    fields = {k: [str(v.dtype), list(v.shape)] for k, v in ((k, np.asarray(v)) for k, v in arrays.items())}
    manifest = {"format": FORMAT, "kind": kind, "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "fields": fields}
    at = f"{folder.rstrip('/')}/v{number}"
    write_bytes(f"{at}/machine.npz", data)
    write_bytes(f"{at}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True).encode())
    return number


_KEPT: dict[tuple[str, str], object] = {}


@dataclass(frozen=True)
class Stored:
    """A machine in a file, with the methods of its kind."""

    path: str
    kind: str
    sha256: str

    def machine(self):
        key = (self.path, self.sha256)
        if key not in _KEPT:
            data = read_bytes(f"{self.path}/machine.npz")
            if hashlib.sha256(data).hexdigest() != self.sha256:
                raise ValueError(f"{self.path} is not what its manifest says")
            with np.load(io.BytesIO(data), allow_pickle=False) as a:
                _KEPT[key] = machine_of(self.kind, dict(a))
        return _KEPT[key]

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.machine(), name)


def load(folder: str, version: int | None = None) -> Stored:
    """The newest version, or one by number. A manifest of a later format is an error."""
    number = max(versions(folder), default=0) if version is None else version
    if number not in versions(folder):
        raise ValueError(f"{folder} holds no version {number or 1}")
    at = f"{folder.rstrip('/')}/v{number}"
    manifest = json.loads(read_bytes(f"{at}/manifest.json"))
    if manifest["format"] > FORMAT:
        raise ValueError(f"{at} has format {manifest['format']}, this is format {FORMAT}")
    return Stored(at, manifest["kind"], manifest["sha256"])
