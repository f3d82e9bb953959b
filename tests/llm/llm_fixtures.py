import random


def prose(seed, n, letters="abcdefghij"):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(letters, k=draw.randint(2, 7))) for _ in range(n))
