"""An independent LinUCB used as a reference in tests: every decision is made
from the whole history by the closed form (discounted sums, one solve)."""

import numpy as np


class HistoryLinUCB:
    def __init__(self, k, d, alpha, lam, gamma):
        self.k, self.d, self.alpha, self.lam, self.gamma = k, d, alpha, lam, gamma
        self.past = [([], []) for _ in range(k)]
        self.extra = [(np.zeros((d, d)), np.zeros(d)) for _ in range(k)]

    def state(self, arm):
        """A = gamma^n lam I + sum gamma^(n-1-t) x x', b likewise."""
        xs, rs = self.past[arm]
        n = len(xs)
        a, b = self.extra[arm]
        a, b = a + self.gamma ** n * self.lam * np.eye(self.d), b.copy()
        if n:
            w = self.gamma ** np.arange(n - 1, -1, -1.0)
            m = np.array(xs)
            a, b = a + (m.T * w) @ m, b + (m.T * w) @ np.array(rs)
        return a, b

    def scores(self, x):
        out = []
        for arm in range(self.k):
            a, b = self.state(arm)
            theta, spread = np.linalg.solve(a, np.stack([b, x], axis=1)).T
            out.append(float(theta @ x + self.alpha * np.sqrt(x @ spread)))
        return out

    def choose(self, x):
        s = self.scores(x)
        arm = int(np.argmax(s))  # the first of equal ones
        return arm, s[arm]

    def update(self, arm, x, r):
        self.past[arm][0].append(np.asarray(x, float))
        self.past[arm][1].append(float(r))
