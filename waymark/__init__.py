"""Navigation-data analytics on Spark.

The names below are those that an evaluation needs; they are imported when asked for.
"""

from importlib import import_module

_PLACES = {
    "adapted": "operators.episodes", "for_task": "operators.episodes", "task_type": "operators.episodes", "TASKS": "operators.episodes", "Task": "operators.episodes", "register": "operators.episodes",
    "MEASURES": "operators.measures", "measure": "operators.measures", "evaluated": "operators.measures",
    "CONFIGS": "operators.clients", "ModelClient": "operators.clients", "model_client": "operators.clients", "commands": "operators.clients", "ChatClient": "operators.clients",
    "object_success": "operators.joins", "point_collisions": "operators.grid", "path_collisions": "operators.grid", "safe_moves": "operators.grid", "obstacle_cells": "operators.grid",
}

__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(import_module(f".{_PLACES[name]}", __name__), name)
    raise AttributeError(name)
