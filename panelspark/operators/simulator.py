"""Event-driven execution: next-open orders under cash, lots, participation and limits.

Cash and positions carry from order to order, so a scenario is one sequential
group; scenarios run side by side. A group holds the market rows of the names
that its targets ever name, day by day.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .portfolio import Costs


@dataclass(frozen=True)
class Rules:
    cash: float = 1_000_000.0
    lot: int = 100
    participation: float | None = 0.05
    max_turnover: float | None = None
    least_amount: float = 0.0
    delay: int = 1


ORDER = "order_date date, trade_date date, ts_code string, side string, quantity bigint, filled_quantity bigint, price double, cost double, status string, reason string"
NAV = "trade_date date, nav double, cash double, market_value double, cost double, ret double, gross_ret double, turnover double, holding_count bigint"
POSITION = "trade_date date, ts_code string, quantity bigint, price double, value double, weight double"
OUT = f"scenario string, kind string, orders struct<{', '.join(x.replace(' ', ':', 1) for x in ORDER.split(', '))}>, nav struct<{', '.join(x.replace(' ', ':', 1) for x in NAV.split(', '))}>, position struct<{', '.join(x.replace(' ', ':', 1) for x in POSITION.split(', '))}>"


class Book:
    """Cash, positions and the last close of each name."""

    def __init__(self, rules: Rules, costs: Costs) -> None:
        self.rules, self.costs, self.cash = rules, costs, rules.cash
        self.held: dict[str, int] = {}
        self.last: dict[str, float] = {}

    def cost(self, value: float, side: str) -> float:
        c = self.costs
        if value <= 0:
            return 0.0
        rate = c.commission_sell if side == "sell" else c.commission_buy
        return max(value * rate, c.least_commission) + value * (c.slippage + c.impact + (c.stamp_sell if side == "sell" else 0.0))

    def value(self, price: dict[str, float]) -> float:
        return self.cash + sum(q * price.get(k, self.last.get(k, 0.0)) for k, q in self.held.items())

    def affordable(self, price: float, want: int) -> int:
        """Most whole lots whose price and cost the cash covers."""
        c, lot = self.costs, self.rules.lot
        q = min(want, int(self.cash / (price * (1 + c.commission_buy + c.slippage + c.impact))) // lot * lot)
        while q > 0 and q * price + self.cost(q * price, "buy") > self.cash + 1e-9:
            q -= lot
        return max(q, 0)

    def fill(self, row: dict | None, code: str, side: str, want: int) -> tuple[int, float, float, str, str]:
        """(filled, price, cost, status, reason) of an order for `want` pieces."""
        r, nothing = self.rules, lambda why: (0, 0.0, 0.0, "unfilled", why)
        if row is None or not row["open"] > 0:
            return nothing("no_market_price")
        amount = row.get("amount")
        known = amount is not None and amount == amount
        if known and amount < r.least_amount:
            return nothing("low_liquidity")
        price, reason, left = row["open"], "", want
        block = row.get("sell_block_reason" if side == "sell" else "buy_block_reason")
        block = block if isinstance(block, str) else None
        if r.participation is not None:
            top = int(amount * r.participation / price) // r.lot * r.lot if known else 0
            if left > top:
                left, reason = top, "volume_participation_limit" if known else "missing_amount"
        if left > 0 and side == "buy":
            left = left // r.lot * r.lot
        if left <= 0:
            return nothing(block or reason or "lot_size")
        if block:
            return nothing(block)
        if side == "sell":
            have = self.held.get(code, 0)
            if have <= 0:
                return nothing("insufficient_position")
            if left > have:
                left, reason = have, "insufficient_position"
        else:
            q = self.affordable(price, left)
            if q <= 0:
                return nothing("insufficient_cash")
            if q < left:
                left, reason = q, "insufficient_cash"
        paid = self.cost(left * price, side)
        self.cash += (left * price if side == "sell" else -left * price) - paid
        self.held[code] = self.held.get(code, 0) + (-left if side == "sell" else left)
        if not self.held[code]:
            del self.held[code]
        return left, price, paid, "filled" if left == want else "partially_filled", reason if left < want else ""


def simulate(market: pd.DataFrame, targets: pd.DataFrame, rules: Rules, costs: Costs) -> tuple[list[dict], list[dict], list[dict]]:
    """(orders, nav, positions) of one scenario. market: trade_date, ts_code, open, close[, amount, *_block_reason]."""
    book, orders, navs, places = Book(rules, costs), [], [], []
    days = sorted(market["trade_date"].unique())
    due: dict = {}
    for signal, rows in targets.sort_values("trade_date").groupby("trade_date"):
        later = [d for d in days if d > signal][rules.delay - 1 : rules.delay]
        if later:
            due[later[0]] = (signal, dict(zip(rows["ts_code"], rows["target_weight"], strict=True)))  # a later signal for the day wins
    before = rules.cash
    for day, rows in market.sort_values(["trade_date", "ts_code"]).groupby("trade_date"):
        row_of = {r["ts_code"]: r for r in rows.to_dict("records")}
        spent = traded = 0.0
        if day in due:
            signal, want = due[day]
            opens = {k: r["open"] for k, r in row_of.items() if r["open"] > 0}
            total = book.value(opens)
            price = lambda k: opens.get(k, book.last.get(k, 0.0))
            delta = {k: want.get(k, 0.0) * total - book.held.get(k, 0) * price(k) for k in {*want, *book.held}}
            gross = sum(map(abs, delta.values()))
            if rules.max_turnover is not None and total > 0 and gross / total > 2 * rules.max_turnover:
                delta = {k: d * 2 * rules.max_turnover * total / gross for k, d in delta.items()}
            sells = sorted((d, k) for k, d in delta.items() if d < 0)
            buys = sorted((-d, k) for k, d in delta.items() if d > 0)
            for d, k in [*sells, *((-d, k) for d, k in buys)]:
                side, p = ("sell" if d < 0 else "buy"), price(k)
                q = int(abs(d) / p) if p > 0 else 0
                if side == "sell" and want.get(k, 0.0) == 0 and rules.max_turnover is None:
                    q = book.held.get(k, 0)  # a full exit sells odd lots too
                elif side == "buy":
                    q = q // rules.lot * rules.lot
                if q <= 0:
                    if p > 0:
                        continue
                got, at, paid, status, reason = book.fill(row_of.get(k), k, side, q)
                spent, traded = spent + paid, traded + got * at
                orders.append({"order_date": signal, "trade_date": day, "ts_code": k, "side": side, "quantity": q, "filled_quantity": got, "price": at, "cost": paid, "status": status, "reason": reason})
        book.last |= {k: r["close"] for k, r in row_of.items() if r["close"] > 0}
        nav = book.value({})
        worth = nav - book.cash
        navs.append({"trade_date": day, "nav": nav, "cash": book.cash, "market_value": worth, "cost": spent, "ret": nav / before - 1, "gross_ret": (nav + spent) / before - 1, "turnover": traded / 2 / before, "holding_count": len(book.held)})
        places += [{"trade_date": day, "ts_code": k, "quantity": q, "price": book.last.get(k, 0.0), "value": q * book.last.get(k, 0.0), "weight": q * book.last.get(k, 0.0) / nav} for k, q in sorted(book.held.items())]
        before = nav
    return orders, navs, places


def run_scenarios(market: DataFrame, targets: DataFrame, scenarios: dict[str, tuple[Rules, Costs]]) -> DataFrame:
    """One row an order, day or position of each scenario (see OUT); scenarios are groups of their own."""
    spark = market.sparkSession
    named = targets.select("ts_code").distinct()
    cols = ["trade_date", "ts_code", "open", "close", *(c for c in ("amount", "buy_block_reason", "sell_block_reason") if c in market.columns)]
    m = market.join(named, "ts_code", "left_semi").select(*cols)
    grid = lambda: F.broadcast(spark.createDataFrame([(k,) for k in scenarios], "scenario string"))  # noqa: E731  one for each side

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rules, costs = scenarios[key[0]]
        orders, navs, places = simulate(left.drop(columns="scenario"), right.drop(columns="scenario"), rules, costs)
        rows = [(key[0], "order", x, None, None) for x in orders] + [(key[0], "nav", None, x, None) for x in navs] + [(key[0], "position", None, None, x) for x in places]
        return pd.DataFrame(rows, columns=["scenario", "kind", "orders", "nav", "position"])

    left, right = m.crossJoin(grid()), targets.select("trade_date", "ts_code", "target_weight").crossJoin(grid())  # each scenario is a full run
    return left.groupBy("scenario").cogroup(right.groupBy("scenario")).applyInPandas(run, OUT)


def part(results: DataFrame, kind: str) -> DataFrame:
    column = {"order": "orders"}.get(kind, kind)
    return results.where(F.col("kind") == kind).select("scenario", f"{column}.*")


def scenario_grid(rules: Rules, costs: Costs, cost_scales=(0.0, 1.0, 2.0), delays=(1, 2, 3), participations=(0.01, 0.05, 0.10), cash=(1e6, 5e6, 1e7)) -> dict[str, tuple[Rules, Costs]]:
    return {f"cost{k:g}-delay{d}-part{p:g}-cash{c:g}": (replace(rules, delay=d, participation=p, cash=c), costs.scaled(k)) for k in cost_scales for d in delays for p in participations for c in cash}
