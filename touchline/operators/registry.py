"""A registry of model versions: an append-only journal, states folded from it, promotion by compare and set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from touchline.sources.published import Journal

#: Metrics of which less is better; of all others more is.
LESS = ("rps", "brier", "log_loss", "ece")
SCHEMA = "model_id string, scope string, status string, metrics map<string,double>, entry long"


@dataclass
class State:
    """What the journal says up to its entry ``last``: model id -> row."""

    last: int
    models: dict[str, dict]


class Registry:
    """register, promote, archive, compare. ``scope`` is what has one active model, such as a league."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.journal = spark, Journal(spark, path)

    def state(self) -> State:
        """Fold the journal: a promotion of a scope archives its active model."""
        models: dict[str, dict] = {}
        last = self.journal.last()
        for number, e in self.journal.entries():
            if number > last:
                break
            if e["event"] == "register":
                for m in e["models"]:
                    models.setdefault(m["model_id"], {**m, "status": "staging", "entry": number})
            elif e["event"] == "promote":
                for model_id in e["models"]:
                    m = models[model_id]
                    for other in models.values():
                        if other["scope"] == m["scope"] and other["status"] == "production":
                            other |= {"status": "archived", "entry": number}
                    m |= {"status": "production", "entry": number}
            elif e["event"] == "archive":
                models[e["model_id"]] |= {"status": "archived", "entry": number}
        return State(last, models)

    def register(self, models: list[dict]) -> int:
        """One entry for all of ``models``: model_id, scope, metrics. An id that is known keeps what it was registered with."""
        return self.journal.append({"event": "register", "models": [{"model_id": m["model_id"], "scope": m["scope"], "metrics": dict(m["metrics"])} for m in models]})

    def promote(self, model_ids: list[str], seen: State) -> int:
        """Make them the active ones of their scopes, if nothing was written since ``seen``; else ``Conflict``, and the caller
        looks again. Two promotions from one state leave one."""
        for model_id in model_ids:
            if model_id not in seen.models:
                raise KeyError(f"{model_id} isn't registered")
            if seen.models[model_id]["status"] == "archived":
                raise ValueError(f"{model_id} is archived")
        scopes = [seen.models[m]["scope"] for m in model_ids]
        if len(scopes) != len(set(scopes)):
            raise ValueError("two models for one scope")
        return self.journal.append({"event": "promote", "models": list(model_ids)}, expected=seen.last)

    def archive(self, model_id: str, seen: State) -> int:
        """The active model of a scope can't be archived: promote another first."""
        if model_id not in seen.models:
            raise KeyError(f"{model_id} isn't registered")
        if seen.models[model_id]["status"] == "production":
            raise ValueError(f"{model_id} is active")
        return self.journal.append({"event": "archive", "model_id": model_id}, expected=seen.last)

    def catalogue(self, status: str | None = None) -> DataFrame:
        """A row a model; ``entry`` is the journal's number of its last change."""
        rows = [(m["model_id"], m["scope"], m["status"], {k: float(v) for k, v in m["metrics"].items()}, m["entry"]) for m in self.state().models.values() if status in (None, m["status"])]
        return self.spark.createDataFrame(rows, SCHEMA)

    def compared(self, metric: str, scope: str | None = None) -> list[str]:
        """Ids of models with the metric, best first; ties by id."""
        found = [m for m in self.state().models.values() if metric in m["metrics"] and scope in (None, m["scope"])]
        sign = 1 if metric in LESS else -1
        return [m["model_id"] for m in sorted(found, key=lambda m: (sign * m["metrics"][metric], m["model_id"]))]
