def model_limit(rows, limit, window):
    """One request after the other, as the limiter is defined."""
    state, out = {}, {}
    for key, ts, id in sorted(rows, key=lambda r: (r[1], r[2])):
        now = int(ts.timestamp())
        start, count = state.get(key, (now, 0))
        if now - start > window:
            start, count = now, 0
        state[key] = (start, count + 1)
        out[id] = (start, count + 1, count + 1 <= limit)
    return out
