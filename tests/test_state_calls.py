"""What the registry's state does for many paths, without a session."""

import hashlib

import pandas as pd

from shelfmark.streaming import registry as sr


class State(dict):
    """A state store that counts its calls."""

    calls = 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {"exists": lambda: 0 in self, "get": lambda: dict.get(self, 0), "update": lambda v: self.__setitem__(0, v),
                    "getValue": lambda k: dict.get(self, k), "containsKey": lambda k: k in self,
                    "updateValue": lambda k, v: self.__setitem__(k, v)}[name](*args)
        return lambda *args: call(*args)

    get = property(lambda self: lambda: self.__getattr__("get")())
    update = property(lambda self: lambda v: self.__getattr__("update")(v))


class Handle:
    def __init__(self):
        self.album, self.paths = State(), State()

    def getValueState(self, *_):
        return self.album

    def getMapState(self, *_):
        return self.paths


def arrive(state, paths, second):
    rows = pd.DataFrame({"album_key": "k", "artist": "a", "album": "t", "file_path": paths,
                         "seen_at": pd.Timestamp(2024, 1, 1, 0, 0, second)})
    return next(iter(state.handleInputRows(("k",), iter([rows[:200], rows[200:]]), None))).iloc[0]


def test_paths_of_a_batch_share_calls():
    state, handle = sr.AlbumState(), Handle()
    state.init(handle)
    known = set()
    for second, (paths, action) in enumerate([([f"/{i}" for i in range(500)], "new"), ([f"/{i}" for i in range(300)], "same"),
                                              ([f"/{i}" for i in range(400, 2000)] + [None], "updated"), ([None], "same")]):
        got = arrive(state, paths, second)
        known |= {p for p in paths if p}
        digests = [hashlib.md5(p.encode()).hexdigest() for p in known]
        assert (got.action, got.n_paths, int(got.hash_hi), int(got.hash_lo)) == (
            action, len(known), sum(int(x[:15], 16) for x in digests), sum(int(x[15:30], 16) for x in digests))
        assert (got.first_discovered.second, got.last_scanned.second, got.seq) == (0, second, second + 1)
    assert handle.paths.calls + handle.album.calls < 500  # two calls a path were 4,000 and more
    assert len(handle.paths) == 32 and max(len(v[0]) for v in handle.paths.values()) <= 3 * sr.BUCKET * sr.DIGEST
