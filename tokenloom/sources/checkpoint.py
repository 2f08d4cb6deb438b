"""Checkpoint files: named arrays with their configs, in one uncompressed archive.

A checkpoint is addressed as `folder/file` under a root that all executors share. It holds arrays
and JSON only; nothing in it is run when it is read.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Any, NamedTuple

import numpy as np


class Checkpoint(NamedTuple):
    model_config: dict[str, Any]
    optimizer_config: dict[str, Any]
    model_state: dict[str, np.ndarray]
    optimizer_state: dict[str, np.ndarray]


def file_name(val_loss: float, model_name: str, author: str | None) -> str:
    """The name `scalars.checkpoint_name` gives, for one file."""
    return f"{val_loss:08.4f}val_loss_{model_name}_{(author or 'N/A').replace(' ', '')}.pt"


def _split(path: str) -> tuple[str, str]:
    parts = path.split("/")
    if len(parts) != 2 or not all(parts) or ".." in parts:
        raise ValueError(f"not folder/file: {path}")
    return parts[0], parts[1]


def save_checkpoint(root: str, folder: str, saved: Checkpoint, val_loss: float, model_name: str, author: str | None = None) -> str:
    """Write a checkpoint and return its `folder/file`. An author's slash becomes a dash, as it cannot
    stand in a file name. The file appears whole or not at all; one of the same name is replaced."""
    path = f"{folder}/{file_name(val_loss, model_name, author).replace('/', '-')}"
    _split(path)
    os.makedirs(os.path.join(root, folder), exist_ok=True)
    config = json.dumps({"model_config": saved.model_config, "optimizer_config": saved.optimizer_config})
    arrays = {f"model/{k}": v for k, v in saved.model_state.items()} | {f"optimizer/{k}": v for k, v in saved.optimizer_state.items()}
    target = os.path.join(root, path)
    part = f"{target}.{uuid.uuid4().hex[:8]}.part"
    with open(part, "wb") as f:
        np.savez(f, config=np.frombuffer(config.encode(), np.uint8), **arrays)
    os.replace(part, target)
    return path


def load_checkpoint(root: str, path: str) -> Checkpoint:
    """Read `folder/file`; any other form of path, or a file of another kind, raises ValueError."""
    target = os.path.join(root, *_split(path))
    with np.load(target, allow_pickle=False) as z:
        if "config" not in z.files:
            raise ValueError(f"{path} is no checkpoint")
        config = json.loads(z["config"].tobytes().decode())
        state = {k: z[k] for k in z.files}
    own = lambda prefix: {k[len(prefix) :]: v for k, v in state.items() if k.startswith(prefix)}
    return Checkpoint(config["model_config"], config["optimizer_config"], own("model/"), own("optimizer/"))
