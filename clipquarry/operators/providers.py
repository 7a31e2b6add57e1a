"""Models behind a function: prompt -> text. A provider is made in the Python worker, so that a client or a model is opened
once in each and never sent about; failures stay in their row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semistructured import salvage

Provider = Callable[[str], str]
NO_JSON = "no JSON in the answer"


def generate(prompts: DataFrame, make: Callable[[], Provider], tries: int = 2, note: str = "\nAnswer with JSON only.") -> DataFrame:
    """prompts (any columns and prompt) with reply (the JSON value of the answer) and error. An answer without JSON is asked for again, with a note; a failure of one row is its error and null reply, the others go on. A null prompt is not asked."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()

        def one(prompt: str | None) -> tuple[str | None, str | None]:
            error = None
            for k in range(tries if prompt is not None else 0):
                try:
                    value = salvage(ask(prompt + (note if k else "")))
                    if value is not None:
                        return value, None
                    error = NO_JSON
                except Exception as e:  # noqa: BLE001  whatever a provider raises is the row's error
                    error = f"{type(e).__name__}: {e}"
            return None, error

        for pdf in batches:
            got = [one(p) for p in pdf["prompt"]]
            yield pdf.assign(reply=[g[0] for g in got], error=[g[1] for g in got])

    return prompts.mapInPandas(run, ", ".join([*names, "reply string", "error string"]))


def answers(prompts: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """prompts (any columns and prompt) with answer, the text as it comes, and error; a failure of one row is its error and null answer. A null prompt is not asked."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()

        def one(prompt: str | None) -> tuple[str | None, str | None]:
            try:
                return (None if prompt is None else ask(prompt)), None
            except Exception as e:  # noqa: BLE001  whatever a provider raises is the row's error
                return None, f"{type(e).__name__}: {e}"

        for pdf in batches:
            got = [one(p) for p in pdf["prompt"]]
            yield pdf.assign(answer=[g[0] for g in got], error=[g[1] for g in got])

    return prompts.mapInPandas(run, ", ".join([*names, "answer string", "error string"]))


def in_passes(episodes: DataFrame, make: Callable[[], Provider], template: str, target: int = 5, passes: int = 3) -> DataFrame:
    """(ep, rank, s, e, title, pass, seconds, error): moments in whole seconds of episodes (ep, transcript, starts, ends), a model asked again, told what is taken, until ``target`` are valid, the passes are over or a call fails. An episode without any has one row of nulls, with the time and the error. Episodes run in parallel; passes of one follow each other."""
    from .records import accepted

    kind = episodes.schema["ep"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import time

        ask = make()
        for pdf in batches:
            rows = []
            for ep, transcript, starts, ends in zip(pdf["ep"], pdf["transcript"], pdf["starts"], pdf["ends"], strict=True):
                began, got, error = time.perf_counter(), [], None
                for k in range(1, passes + 1):
                    taken = ", ".join(f"[{m['s']}-{m['e']}]" for m in got)
                    told = f"\nTAKEN ALREADY (don't repeat or overlap): {taken}" if got else ""
                    try:
                        value = json.loads(salvage(ask(template.replace("{transcript}", transcript or "") + told)) or "[]")
                    except Exception as e:  # noqa: BLE001  whatever a provider raises ends this episode's passes only
                        error = f"{type(e).__name__}: {e}"
                        break
                    items = value if isinstance(value, list) else next((v for v in value.values() if isinstance(v, list)), []) if isinstance(value, dict) else []
                    new = [{"s": whole(x.get("start")), "e": whole(x.get("end")), "title": str(x.get("title") or ""), "pass": k} for x in items if isinstance(x, dict)]
                    got = accepted([*got, *new], list(starts), list(ends), target)
                    if len(got) >= target:
                        break
                seconds = time.perf_counter() - began
                rows += [(ep, i + 1, m["s"], m["e"], m["title"], m["pass"], seconds, error) for i, m in enumerate(got)] or [(ep, None, None, None, None, None, seconds, error)]
            yield pd.DataFrame(rows, columns=["ep", "rank", "s", "e", "title", "pass", "seconds", "error"], dtype=object)

    def whole(x: object) -> int | None:
        try:
            return int(x)  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return None

    return episodes.select("ep", "transcript", "starts", "ends").mapInPandas(run, f"ep {kind}, rank long, s long, e long, title string, pass long, seconds double, error string")


def each_file(files: DataFrame, make: Callable[[], Provider], done: DataFrame | None = None) -> DataFrame:
    """(path, status, result, error) of every file (path): a program outside (speech recognition, say) run on each that is not among those done; status is done, skipped or failed, and a failure keeps nothing else from running."""
    x = files.select("path")
    skipped = x.join(done.select("path").distinct(), "path", "left_semi") if done is not None else x.limit(0)
    todo = x.join(done.select("path").distinct(), "path", "left_anti") if done is not None else x
    ran = answers(todo.withColumn("prompt", F.col("path")), make)
    ran = ran.select("path", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), F.col("answer").alias("result"), "error")
    return ran.unionByName(skipped.withColumns({"status": F.lit("skipped"), "result": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}))


def all_failed(replies: DataFrame, key: str) -> DataFrame:
    """Keys of which no row has a reply: where a caller stops rather than go on with nothing."""
    return replies.groupBy(key).agg(F.count("reply").alias("__n")).filter("__n = 0").select(key)


def rule_based() -> Provider:
    """A stand-in model for tests and dry runs: it answers with the times of the first and last line it is shown."""
    import json
    import re

    def ask(prompt: str) -> str:
        spans = [(int(a), int(b)) for a, b in re.findall(r"^\[(\d+)-(\d+)\]", prompt, flags=re.M)]
        if not spans:
            return "nothing found"
        words = re.findall(r"[^\W\d_]{4,}", prompt.rsplit("]", 1)[-1])
        item = {"start": spans[0][0], "end": max(spans[0][0] + 1, spans[-1][1]), "title": " ".join(words[:3]), "score": 1 + len(prompt) % 10, "quote": " ".join(words[:8])}
        return "Here you are:\n```json\n" + json.dumps({"moments": [item]}, ensure_ascii=False)[:-1]  # cut short, as answers are

    return ask


def echoing(raise_score: float = 0.0) -> Callable[[], Provider]:
    """A stand-in for models that refine lists: it answers with the candidates it is shown, rated a little higher."""

    def make() -> Provider:
        import json

        def ask(prompt: str) -> str:
            at = prompt.find("CANDIDATES\n")
            if at < 0:
                return "[]"
            items = json.JSONDecoder().raw_decode(prompt[at + 11 :])[0]
            return json.dumps({"moments": [{**x, "score": x.get("score", 0) + raise_score} for x in items]}, ensure_ascii=False)

        return ask

    return make


def summarising() -> Provider:
    """A stand-in for a model that sums an episode up: the first words of its digest."""
    import json

    def ask(prompt: str) -> str:
        return json.dumps({"summary": " ".join(prompt.split()[1:9]), "topics": ["talk"], "tone": "calm"}, ensure_ascii=False)

    return ask
