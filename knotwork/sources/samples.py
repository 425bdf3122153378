"""Small public graphs for examples, tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The social network of 62 dolphins (Lusseau and others, 2003); each line is a vertex and its larger neighbours.
DOLPHINS = """
1: 11 15 16 41 43 48
2: 18 20 27 28 29 37 42 55
3: 11 43 45 62
4: 9 15 60
5: 52
6: 10 14 57 58
7: 10 14 18 55 57 58
8: 20 28 31 41 55
9: 21 29 38 46 60
10: 14 18 33 42 58
11: 30 43 48
12: 52
13: 34
14: 18 33 42 55 58
15: 17 25 34 35 38 39 41 44 51 53
16: 19 25 41 46 56 60
17: 21 34 38 39 51
18: 23 26 28 32 58
19: 21 22 25 30 46 52
20: 31 55
21: 29 37 39 45 48 51
22: 30 34 38 46 52
24: 37 46 52
25: 30 46 52
26: 27 28
27: 28
29: 31 48
30: 36 44 46 52 53
31: 43 48
33: 61
34: 35 38 39 41 44 51
35: 38 45 50
37: 38 40 41 60
38: 41 44 46 62
39: 44 45 53 59
40: 58
41: 53
42: 55 58
43: 48 51
44: 47 54
46: 51 52 60
47: 50
49: 58
51: 52
52: 56
54: 62
55: 58
"""


def dolphin_pairs() -> list[tuple[int, int]]:
    """The 159 edges."""
    lines = (line.split(": ") for line in DOLPHINS.strip().split("\n"))
    return [(int(u), int(v)) for u, rest in lines for v in rest.split()]


def dolphins(spark: SparkSession) -> DataFrame:
    """src, dst of the dolphins' edges."""
    return spark.createDataFrame(dolphin_pairs(), "src long, dst long")
