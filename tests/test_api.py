import tessera


def test_public_names():
    assert all(getattr(tessera, n) is not None for n in tessera.__all__)
