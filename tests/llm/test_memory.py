"""What a worker holds between stages."""

from evenhand.llm import common


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    seen = []

    class Pool:
        def release_unused(self):
            seen.append("released")

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)

    def double(batches):
        for b in batches:
            yield 2 * b
        seen.append("ended")

    assert list(common.giving_back(double)(iter([1, 2]))) == [2, 4]
    assert seen == ["ended", "released"]
