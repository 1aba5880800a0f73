"""Random matches as tables, small enough for plain-Python answers."""

import random
from dataclasses import dataclass, field

SCHEMAS = {
    "damage": "match_id string, t double, source string, target string, magnitude double, x double, y double",
    "teams": "match_id string, t double, player_id string, team_index long",
    "elims": "match_id string, t_ms long, eliminator string, eliminated string, knocked boolean",
    "players": "match_id string, player_id string, is_bot boolean, death_time double",
    "matches": "match_id string, replay_owner string",
    "positions": "match_id string, player_id string, t double, x double, y double, z double, in_storm boolean",
}


@dataclass
class Tables:
    """Rows per table, as plain tuples."""

    rows: dict = field(default_factory=lambda: {name: [] for name in SCHEMAS})

    def frames(self, spark):
        return {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in self.rows.items()}

    def of(self, name, match):
        return [r for r in self.rows[name] if r[0] == match]


def random_match(tables, name, seed, players=6, team_size=2, minutes=3.0, hits=60):
    """Times on a grid of quarter seconds, so that equal times, exact gaps and exact windows occur."""
    r = random.Random(seed)
    quarter = lambda high: r.randrange(int(high * 4)) / 4
    ids = [("BOT_" if r.random() < 0.1 else "u") + str(i) for i in range(players)]
    rows = tables.rows
    rows["matches"].append((name, r.choice(ids)))
    for i, p in enumerate(ids):
        rows["players"].append((name, p, r.random() < 0.15, quarter(60 * minutes) if r.random() < 0.6 else None))
        rows["teams"].append((name, 0.0, p, i // team_size))
    for t in sorted({quarter(60 * minutes) + 0.1 for _ in range(2)}):
        rows["teams"].append((name, t, r.choice(ids), r.randrange(players // team_size)))
    for _ in range(hits):
        start = quarter(60 * minutes)
        for _ in range(r.randrange(1, 4)):
            start += r.choice([0.0, 0.25, 1.0, 3.0, 10.0])
            rows["damage"].append((name, start, r.choice(ids), r.choice([*ids, None]), float(r.choice([0, 5, 20, 60])), quarter(40) * 100, quarter(40) * 100))
    seen = set()
    for _ in range(hits // 3):
        t = quarter(60 * minutes)
        rows["elims"].append((name, int(t * 1000), r.choice([*ids, None]), r.choice(ids), r.random() < 0.7))
    for _ in range(hits * 4):
        key = (r.choice(ids), quarter(60 * minutes))
        if key not in seen:  # no two positions of a player at one time
            seen.add(key)
            rows["positions"].append((name, *key, quarter(40) * 100, quarter(40) * 100, quarter(4) * 100, r.choice([True, False, None])))
    return tables


def random_tables(matches=6, seed=1, **size):
    tables = Tables()
    for i in range(matches):
        random_match(tables, f"g{i}", 100 * seed + i, players=6 if i % 3 else 4, team_size=1 if i % 3 == 2 else 2, **size)
    return tables
