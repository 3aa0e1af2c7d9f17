"""A stand-in for h5py where it isn't installed: datasets with attributes, kept in one pickle a file."""

import pickle


class _Data:
    def __init__(self, data):
        self.data, self.attrs = data, {}

    shape = property(lambda self: self.data.shape)
    chunks = property(lambda self: (1, 2))

    def __getitem__(self, key):
        return self.data[key]


class File:
    def __init__(self, path, mode="r"):
        self.path, self.mode, self.sets = path, mode, {}
        if mode == "r":
            held = pickle.loads(path.read()) if hasattr(path, "read") else pickle.loads(open(path, "rb").read())
            for name, (data, attrs) in held.items():
                self.sets[name] = _Data(data)
                self.sets[name].attrs.update(attrs)

    def create_dataset(self, name, data):
        self.sets[name] = _Data(data)
        return self.sets[name]

    def __getitem__(self, name):
        return self.sets[name]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.mode == "w":
            with open(self.path, "wb") as f:
                pickle.dump({k: (v.data, v.attrs) for k, v in self.sets.items()}, f)
