"""Calls to a service: once a key, tried again, gone on with, stopped by refusals."""

import os
import uuid

from graphloom.sources.calls import Refused, answers, ask


class Stub:
    """Notes every call in a folder; fails or refuses for keys that a file names."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        def one(request):
            open(os.path.join(self.folder, f"{request}.{uuid.uuid4().hex}"), "w").close()
            told = os.path.join(self.folder, "told")
            how = open(told).read().split() if os.path.exists(told) else []
            if f"refuse:{request}" in how or "refuse:all" in how:
                raise Refused(0.0)
            if f"fail:{request}" in how:
                raise OSError("down")
            return f"answer to {request}"

        return one

    def tell(self, text):
        with open(os.path.join(self.folder, "told"), "w") as f:
            f.write(text)

    def calls(self):
        return sorted(n.split(".")[0] for n in os.listdir(self.folder) if n != "told")


def rows(spark, n):
    return spark.createDataFrame([(f"k{i}", f"r{i}") for i in range(n)] + [("k0", "r9"), (None, "x"), ("y", None)], "key string, request string")


def test_a_key_is_asked_once_and_failures_are_asked_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    stub, path = Stub(str(tmp_path / "calls")), str(tmp_path / "answers")
    stub.tell("fail:r2 fail:r5")
    kept = dict(client=stub, path=path, lots=2, lanes=2, interval=0.0, tries=3)
    assert ask(rows(spark, 8), **kept) == {"ok": 6, "failed": 2}
    assert stub.calls() == sorted(["r0", "r1", "r3", "r4", "r6", "r7", *["r2"] * 3, *["r5"] * 3])
    assert {r.key: r.answer for r in answers(spark, path).collect()} == {f"k{i}": f"answer to r{i}" for i in (0, 1, 3, 4, 6, 7)}
    stub.tell("")
    assert ask(rows(spark, 8), **kept) == {"ok": 8}
    assert stub.calls().count("r2") == 4 and stub.calls().count("r1") == 1
    assert ask(rows(spark, 8), **kept) == {"ok": 8} and len(stub.calls()) == 14


def test_three_refusals_stop_a_lane(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    stub, path = Stub(str(tmp_path / "calls")), str(tmp_path / "answers")
    stub.tell("refuse:all")
    got = ask(rows(spark, 10), stub, path, lanes=1, interval=0.0, tries=2)
    assert len(stub.calls()) == 3 and got == {"failed": 2, "skipped": 8}
    stub.tell("refuse:r4")
    # one refusal is waited for and tried again; an answer sets the count back
    assert ask(rows(spark, 10), stub, path, lanes=1, interval=0.0, tries=2) == {"ok": 9, "failed": 1}


def test_calls_keep_to_a_rate(spark, tmp_path):
    from graphloom.sources.calls import _lane

    import pandas as pd

    waits = []
    made = list(_lane(pd.DataFrame({"key": list("abc"), "request": list("abc")}), lambda r: r, 5.0, 1, waits.append))
    assert [m[2] for m in made] == ["ok"] * 3 and len(waits) == 2 and all(4.5 < w <= 5.0 for w in waits)
    assert ask(spark.createDataFrame([], "key string, request string"), Stub("/nowhere"), str(tmp_path / "none")) == {}
