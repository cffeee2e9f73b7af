"""Asynchronous asking: open calls, retries and endpoints."""

import zlib

from veridian.streaming.resumable import ask_concurrently


def test_slow_and_failing_endpoints(spark):
    def client():
        state = {"open": 0, "most": 0}

        async def ask(endpoint, prompt):
            import asyncio

            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
            try:
                if endpoint == "broken":
                    raise RuntimeError("broken endpoint")
                if endpoint == "mute":
                    return None
                if prompt == "never":
                    await asyncio.sleep(30)
                await asyncio.sleep(0.02)
                return f"{prompt} from {endpoint}, {state['most']} open"
            finally:
                state["open"] -= 1

        return ask

    ends = ["broken", "good", "mute"]
    rows = [(f"k{i}", f"p{i}") for i in range(60)] + [("x", "never"), ("y", None)]
    df = spark.createDataFrame(rows, "id string, prompt string")
    got = {r.id: r for r in ask_concurrently(df, client(), ends, 5, 2, 3, 0.001, 0.5).collect()}
    assert set(got) == {k for k, _ in rows}
    for i in range(60):
        r = got[f"k{i}"]
        first = zlib.crc32(f"k{i}".encode()) % 3
        assert r.caption.startswith(f"p{i} from good") and r.retry_attempts == {0: 1, 1: 0, 2: 2}[first] and r.error is None
    most = max(int(r.caption.split(", ")[1].split()[0]) for r in got.values() if r.caption)
    assert 1 < most <= 5
    assert got["x"].caption is None and got["x"].retry_attempts == 2 and got["x"].error
    assert (got["y"].caption, got["y"].error) == (None, "no prompt")


def test_one_endpoint_and_no_rows(spark):
    async def ask(endpoint, prompt):
        return None if prompt == "b" else prompt.upper()

    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, prompt string")
    assert {r.id: (r.caption, r.retry_attempts, r.error) for r in ask_concurrently(df, ask, ["e"], 1, attempts=2, pause=0.0).collect()} == {"1": ("A", 0, None), "2": (None, 1, "no answer")}
    assert ask_concurrently(df.limit(0), ask, ["e"], 1).count() == 0
