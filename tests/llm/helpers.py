"""Small tables and plain versions of what the operators compute."""

import random

HEX = "0123456789ABCDEF"
INVENTORY = "sha string, split string, timestamp string, family string, file_size long, disarmed_content_sha256 string, tlsh string, tlsh_status string, id string, content long, side int"


def random_digest(r: random.Random) -> str:
    return "".join(r.choice(HEX) for _ in range(70))


def edited(digest: str, steps: int, r: random.Random) -> str:
    """The digest with `steps` single steps at values of the body."""
    d = list(digest)
    for _ in range(steps):
        i = r.randrange(6, 70)
        v, low = int(d[i], 16), r.random() < 0.5
        x = v & 3 if low else v >> 2
        x = x + 1 if x == 0 or (x < 3 and r.random() < 0.5) else x - 1
        d[i] = HEX[(v & 12) | x if low else (v & 3) | x << 2]
    return "".join(d)


def distance(a: str, b: str) -> int:
    from tidemark.streaming.streams import _steps

    return _steps(a, b)


def row(sha, digest="", content=None, split="train", ts="2019-09-01 00:00:00+00:00", status="VALID"):
    """An inventory row with three extra columns whose names operators use themselves."""
    return (sha, split, ts, "fam", 1, content, digest, status, "x", 7, 1)


def pairs(df):
    return {tuple(r) for r in df.collect()}
