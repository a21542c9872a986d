"""Row-at-a-time simulation of the reference operator, used only as a test oracle.

One operator instance per routing partition: per element, count into the window map (a missing window map is
created, so late elements re-open a window); per watermark, emit every window with end < watermark, move it to
the retained map and arm a cleanup timer at now + delay; a timer clears the retained map only if it is the most
recently armed one. Lookup: live count, else retained count, else 0."""

from windowstate.functions import keyhash as K

MASK = 0xFFFFFFFF


def java_rem(a, b):
    r = abs(a) % abs(b)
    return -r if a < 0 else r


def window_end(ts, size):
    return ts - java_rem(ts, size) + size


def _mul(x, c):
    return (x * c) & MASK


def _rotl(x, r):
    return ((x << r) | (x >> (32 - r))) & MASK


def murmur(code):
    # plain-integer version of the library's column chain (same constants), for an independent check
    code &= MASK
    code = _mul(code, K.C1)
    code = _rotl(code, K.ROT1)
    code = _mul(code, K.C2)
    code = _rotl(code, K.ROT2)
    code = _mul(code, K.C3)
    code ^= K.XOR_LEN
    code ^= code >> K.FINAL_SHIFTS[0]
    code = _mul(code, K.C4)
    code ^= code >> K.FINAL_SHIFTS[1]
    code = _mul(code, K.C5)
    code ^= code >> K.FINAL_SHIFTS[2]
    signed = code - (1 << 32) if code >= (1 << 31) else code
    if signed >= 0:
        return signed
    return -signed if signed != -(1 << 31) else 0


def long_hash(k):
    k &= 0xFFFFFFFFFFFFFFFF
    return (k ^ (k >> 32)) & MASK


def partition(key, n):
    return murmur(long_hash(key)) % n


class Operator:
    def __init__(self, size, cleanup_delay):
        self.size, self.delay = size, cleanup_delay
        self.windows, self.retained = {}, {}
        self.last_trigger = 0
        self.timers = []

    def element(self, ts, key):
        w = self.windows.setdefault(window_end(ts, self.size), {})
        w[key] = w.get(key, 0) + 1

    def watermark(self, wm, now):
        out = []
        for end in list(self.windows):
            if end < wm:
                out += [(end, k, n) for k, n in self.windows[end].items()]
                self.retained[end] = self.windows.pop(end)
                self.last_trigger = now + self.delay
                self.timers.append(self.last_trigger)
        return out

    def advance(self, now):
        """Fire timers strictly before `now` (at exactly last fire + delay the set is still readable)."""
        due = sorted(t for t in self.timers if t < now)
        self.timers = [t for t in self.timers if t >= now]
        for t in due:
            if t == self.last_trigger:
                self.retained.clear()
                self.last_trigger = -1

    def get(self, ts, key):
        end = window_end(ts, self.size)
        v = self.windows.get(end, {}).get(key)
        if v is None:
            v = self.retained.get(end, {}).get(key)
        return 0 if v is None else v


def simulate(rows, t_of_batch, size, cleanup_delay, n_partitions, upto_batch, read_at):
    """rows: [(b, ts, key)]. Returns (fire_log set, live dict, retained set) after batch `upto_batch`, with the
    retained set read at time `read_at` (>= t of that batch)."""
    ops = [Operator(size, cleanup_delay) for _ in range(n_partitions)]
    batches = sorted({b for b, _, _ in rows})
    fires = []
    wm = None
    for b in batches:
        if b > upto_batch:
            break
        now = t_of_batch(b)
        for op in ops:
            op.advance(now)
        for bb, ts, key in rows:
            if bb == b:
                ops[partition(key, n_partitions)].element(ts, key)
        mx = max(ts for bb, ts, _ in rows if bb == b)
        wm = mx if wm is None else max(wm, mx)
        for p, op in enumerate(ops):
            fires += [(b, p, e, k, n) for e, k, n in op.watermark(wm, now)]
    for op in ops:
        op.advance(read_at)
    live = {}
    for op in ops:
        for e, m in op.windows.items():
            for k, n in m.items():
                live[(e, k)] = live.get((e, k), 0) + n
    retained = {(p, e, k, n) for p, op in enumerate(ops) for e, m in op.retained.items() for k, n in m.items()}
    return set(fires), live, retained, ops
