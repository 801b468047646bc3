"""Small canonical tables for unit tests."""

from datetime import date
from decimal import Decimal

from stockloom.sources.catalog import Tables
from stockloom.sources.schemas import SCHEMAS

AS_OF = date(2024, 6, 15)
D = lambda x: None if x is None else Decimal(str(x))


def frame(spark, name, rows):
    schema = SCHEMAS[name]
    decimals = {f.name for f in schema.fields if f.dataType.simpleString().startswith("decimal")}
    data = [tuple(D(r.get(c)) if c in decimals else r.get(c) for c in schema.names) for r in rows]
    return spark.createDataFrame(data, schema)


def sale(stock="A", day=AS_OF, qty=1, amount=10, channel="CASH", uom="PCS", location="L1", unit_cost=4, promo=False, doc=1):
    return dict(
        channel=channel, doc_no=doc, item_no=1, stock_id=stock, uom_id=uom, location_id=location, doc_date=day, qty=qty, amount=amount,
        unit_cost=unit_cost, has_promo=promo,
    )


def product(stock="A", uom="PCS", rate=1, name=None, ud1="NA", cost=4, active="Y", group="G", category="C", ref=0):
    return dict(
        stock_id=stock, uom_id=uom, base_uom_id="PCS", uom_rate=rate, name=name or f"{stock} {uom}", active_ingredient="X", barcode=f"B{stock}",
        category_id=category, brand_id="BR", ud1_code=ud1, therapeutic_group=group, cost=cost, reference_cost=ref, is_active=active,
    )


def balance(stock="A", qty=5, location="L1", uom="PCS"):
    return dict(stock_id=stock, uom_id=uom, location_id=location, balance_qty=qty)


def tables(spark, sales=(), products=(), balances=(), locations=("L1", "L2"), **more):
    t = Tables(
        sales_line=frame(spark, "sales_line", list(sales)),
        stock_master=frame(spark, "stock_master", list(products)),
        stock_balance=frame(spark, "stock_balance", list(balances)),
        location=frame(spark, "location", [dict(location_id=x, name=f"R1 - {x}", address="", is_active="Y") for x in locations]),
        category=frame(spark, "category", [dict(category_id="C", description="Cat")]),
        brand=frame(spark, "brand", [dict(brand_id="BR", description="Brand")]),
        uom=frame(spark, "uom", [dict(uom_id="PCS", description="Piece")]),
        purchase_order_line=frame(spark, "purchase_order_line", more.get("orders", [])),
        supplier_invoice_line=frame(spark, "supplier_invoice_line", more.get("invoices", [])),
        batch_line=frame(spark, "batch_line", more.get("batches", [])),
        stock_ledger=frame(spark, "stock_ledger", more.get("ledger", [])),
    )
    return t


def rows_by(df, key="stock_id"):
    return {r[key]: r.asDict() for r in df.collect()}
