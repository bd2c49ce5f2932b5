"""What a Python task holds or asks of its state at a time."""

from types import SimpleNamespace

import pandas as pd
import pyarrow as pa

from quarry.plans.queries import _as_hwpx
from quarry.sources import parsed_source
from quarry.streaming.limiter import SlidingLog


class Values:
    def __init__(self):
        self.held, self.calls = {}, 0

    def _at(self, key=None, value=None, gone=False):
        self.calls += 1
        if value is not None:
            self.held[key] = value
        return self.held.pop(key, None) if gone else self.held.get(key)

    def get(self):
        return self._at()

    def update(self, value):
        self._at(None, value)

    def clear(self):
        self._at(gone=True)

    def exists(self):
        self.calls += 1
        return bool(self.held)

    def getValue(self, key):
        return self._at(key)

    def updateValue(self, key, value):
        self._at(key, value)

    def removeKey(self, key):
        self._at(key, gone=True)

    def containsKey(self, key):
        return self._at(key) is not None


def test_the_limiter_asks_its_state_once_for_many_requests():
    waiting, log, timers = Values(), Values(), set()
    job = SlidingLog(10, 3)
    job.init(SimpleNamespace(getMapState=lambda *a: waiting, getValueState=lambda *a: log, registerTimer=timers.add))
    times = [i * 20_000 for i in range(1000)]  # 20 seconds
    list(job.handleInputRows(("k",), iter({"micros": t} for t in times), None))
    now, out = SimpleNamespace(getCurrentWatermarkInMs=lambda: 15_000), []
    while due := [t for t in timers if t <= 15_000]:
        timers.discard(min(due))
        out += list(job.handleExpiredTimer(("k",), now, SimpleNamespace(getExpiryTimeInMs=lambda: min(due))))
    want, kept = [], []
    for t in times[:751]:
        kept = [x for x in kept if x >= t - 10_000_000]
        want.append((t, len(kept) < 3))
        kept += [t] * want[-1][1]
    assert [(r.micros, r.allowed) for r in out] == want and len(waiting.held) == 1
    assert waiting.calls + log.calls < 50


def test_files_are_made_in_few_rows():
    made = list(_as_hwpx(iter([pd.DataFrame({"doc_id": range(1000), "text": ["a"] * 1000})])))
    assert sum(map(len, made)) == 1000 and max(map(len, made)) <= 256


def test_the_writer_takes_arrow_batches(tmp_path):
    page = {"page": 1, "text": "x", "method": "text", "ocr_confidence": None, "flagged": False}
    rows = [{"source_file": f"{i}.txt", "status": "success", "error": None, "pages": [page]} for i in range(5)]
    writer = parsed_source.ParsedWriter([str(tmp_path / "a")], False)
    done = writer.write(iter([pa.RecordBatch.from_pylist(rows, schema=parsed_source._ARROW)]))
    assert (done.rows, done.states, done.least, done.greatest) == (5, ["success"], "0.txt", "4.txt")
    writer.commit([done])
    assert [r for part in parsed_source.ParsedReader(str(tmp_path / "a")).partitions() for b in parsed_source.ParsedReader(str(tmp_path / "a")).read(part) for r in b.to_pylist()] == rows


def test_stretches_are_made_of_few_rows():
    from quarry.llm import suffix_dedup

    batch = pa.RecordBatch.from_pydict({"h": list(range(5000))})
    made = list(suffix_dedup._few_rows(iter([batch])))
    assert sum(b.num_rows for b in made) == 5000 and max(b.num_rows for b in made) <= 1024
