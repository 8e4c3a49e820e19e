"""Row-wise expectations in plain Python: lists of cells, one row after the other."""

import csv


def read_rows(path, encoding, delimiter):
    """Header and rows; an empty line is a row without cells. The header is the first row with a cell."""
    with open(path, encoding=encoding, errors="replace") as f:
        rows = list(csv.reader(f, delimiter=delimiter))
    while rows and not rows[0]:
        rows.pop(0)
    header = [cell.removeprefix("\ufeff") if i == 0 else cell for i, cell in enumerate(rows[0])] if rows else []
    return header, rows[1:]


def cell(row, i):
    """None is an absent cell."""
    return row[i] if i < len(row) else None


def destination(value, chosen, others):
    if value is None or not value.strip():
        return None
    return others if chosen and value not in chosen else value


def export(header, rows, flt=None, files=None, sheets=None, selected=(), dedup=True, others="Остальные"):
    """(file, sheet, cells) of every written row; flt, files and sheets are (column, values) or None."""
    out, seen = [], set()
    picked = [header.index(c) for c in selected if c in header] or list(range(len(header)))
    unique = dedup and bool(selected) and len(picked) < len(header)
    for row in rows:
        if flt and flt[0] in header and flt[1]:
            if cell(row, header.index(flt[0])) not in flt[1]:
                continue
        place = []
        for split in (files, sheets):
            if split and split[0] in header:
                place.append(destination(cell(row, header.index(split[0])), split[1], others))
            else:
                place.append("")
        if None in place:
            continue
        written = tuple(cell(row, i) or "" for i in picked)
        if unique:
            if (*place, written) in seen:
                continue
            seen.add((*place, written))
        out.append((*place, written))
    return out


def number(text):
    try:
        return float(text) if text else 0.0
    except ValueError:
        return 0.0


def pivot(header, rows, row_fields, column_fields, values, flt=None, unique=False):
    """{(row key, column key): [metric values]}"""
    groups, seen = {}, set()
    used = sorted({header.index(c) for c in (*row_fields, *column_fields, *(v for v, _ in values))})
    for row in rows:
        if not any(c.strip() for c in row):
            continue
        if flt and flt[1]:
            value = cell(row, header.index(flt[0]))
            if value is not None and value not in flt[1]:
                continue
        if unique:
            key = tuple(cell(row, i) for i in used)
            if key in seen:
                continue
            seen.add(key)
        keys = []
        for fields in (row_fields, column_fields):
            keys.append(tuple(cell(row, header.index(c)) for c in fields) if fields else ("Итого",))
        if any(None in k for k in keys):
            continue
        groups.setdefault(tuple(keys), []).append(row)
    result = {}
    for keys, members in groups.items():
        metrics = []
        for field, agg in values:
            xs = [number(cell(r, header.index(field))) for r in members]
            real = [x for x in xs if x == x]
            metrics.append(
                {
                    "sum": sum(xs),
                    "avg": sum(xs) / len(xs),
                    "count": float(len(xs)),
                    "max": max(real, default=float("-inf")),
                    "min": min(real, default=float("inf")),
                }[agg]
            )
        result[keys] = metrics
    return result

