"""Substitution scoring: a match/mismatch pair or a symbol matrix, as a dense byte table for the kernels."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Matrix:
    """Square substitution matrix; rows are query symbols, columns target symbols, letters in either case."""

    name: str
    alphabet: str
    rows: tuple[tuple[int, ...], ...]

    def __post_init__(self) -> None:
        if not self.alphabet:
            raise ValueError(f"matrix {self.name}: the alphabet is empty")
        if len({c.upper() for c in self.alphabet}) != len(self.alphabet):
            raise ValueError(f"matrix {self.name}: a symbol occurs twice")
        if len(self.rows) != len(self.alphabet) or any(len(r) != len(self.alphabet) for r in self.rows):
            raise ValueError(f"matrix {self.name}: needs {len(self.alphabet)} x {len(self.alphabet)} scores")

    @staticmethod
    def parse(name: str, text: str) -> Matrix:
        """Header of symbols, then a labelled row of scores for each, in that order; # starts a comment."""
        lines = [x for x in (line.split("#", 1)[0].split() for line in text.splitlines()) if x]
        if not lines:
            raise ValueError(f"matrix {name}: no header")
        header, body = lines[0], lines[1:]
        if any(len(c) != 1 or not c.isascii() for c in header):
            raise ValueError(f"matrix {name}: header symbols must be single ASCII characters")
        if [r[0] for r in body] != header:
            raise ValueError(f"matrix {name}: row labels must repeat the header in order")
        return Matrix(name, "".join(header), tuple(tuple(int(x) for x in r[1:]) for r in body))


#: BLOSUM62 (fixed values, published): scores of each amino acid with itself and those before it.
BLOSUM62_ROWS = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
#: Published scores of the ambiguity codes that differ from the rule of blosum62() (fixed values).
BLOSUM62_OTHER = {"BD": 4, "BK": 0, "BB": 4, "BZ": 1, "ZC": -3, "ZE": 4, "ZZ": 4, "XA": 0, "XS": 0, "XT": 0, "XC": -2, "XP": -2, "XW": -2, "**": 1}


def blosum62() -> Matrix:
    """The 24 x 24 matrix over amino acids, B (N or D), Z (Q or E), X (any) and * (stop).

    B and Z score the mean of their two amino acids, rounded down, X scores -1 and * scores -4, but for BLOSUM62_OTHER.
    """
    lines = [r.split() for r in BLOSUM62_ROWS.strip().splitlines()]
    cell = {a + lines[j][0]: int(v) for a, *values in lines for j, v in enumerate(values)}
    cell |= {k[::-1]: v for k, v in cell.items()}
    alphabet = "".join(r[0] for r in lines) + "BZX*"

    def score(a: str, b: str) -> int:
        for k in (a + b, b + a):
            if k in BLOSUM62_OTHER:
                return BLOSUM62_OTHER[k]
        if "*" in a + b:
            return -4
        if "X" in a + b:
            return -1
        means = {"B": "ND", "Z": "QE"}
        both = [cell[x + y] for x in means.get(a, a) for y in means.get(b, b)]
        return sum(both) // len(both)

    return Matrix("BLOSUM62", alphabet, tuple(tuple(score(a, b) for b in alphabet) for a in alphabet))


def read_matrix(spark, named: Matrix | None = None, path: str | None = None) -> tuple[Matrix, str | None]:
    """A given matrix, or one read from a file by Spark with its SHA-256; the file's stem is its name."""
    if (named is None) == (path is None):
        raise ValueError("give a matrix or a matrix file, not both and not neither")
    if named is not None:
        return named, None
    text = spark.read.text(path, wholetext=True).first()[0]
    stem = path.rstrip("/").rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] or stem
    return Matrix.parse(stem or "custom", text), hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Scoring:
    """Scores of symbol pairs and gaps. Penalties follow the usual signs: gaps negative, mismatch a positive penalty."""

    match: int = 2
    mismatch: int = 1
    gap: int = -2
    gap_open: int = -3
    gap_extend: int = -1
    matrix: Matrix | None = None

    def table(self) -> np.ndarray:
        """256 x 256 scores, query byte first."""
        if self.matrix is None:
            out = np.full((256, 256), -self.mismatch, np.int32)
            np.fill_diagonal(out, self.match)
            return out
        out = np.zeros((256, 256), np.int32)
        codes = [sorted({ord(c.upper()), ord(c.lower())}) for c in self.matrix.alphabet]
        for row, scores in zip(codes, self.matrix.rows, strict=True):
            for column, score in zip(codes, scores, strict=True):
                out[np.ix_(row, column)] = score
        return out

    def label(self) -> str:
        return f"matrix:{self.matrix.name}" if self.matrix else f"match:{self.match},mismatch:{self.mismatch}"

    def foreign(self) -> str | None:
        """Pattern of symbols that the scoring cannot score; None if it scores everything."""
        if self.matrix is None:
            return None
        return "[^" + "".join(f"\\x{ord(c):02x}" for s in self.matrix.alphabet for c in sorted({s.upper(), s.lower()})) + "]"


#: Scorings under which the global kernel computes an edit distance (negated) and a longest common subsequence.
EDIT = Scoring(match=0, mismatch=1, gap=-1)
LCS = Scoring(match=1, mismatch=1_000_000, gap=0)
