"""Canonical tables: column names and Spark types.

Readers apply these schemas instead of inferring, so a missing or mistyped
column fails at read time and scans stay prunable.
"""

from pyspark.sql import types as T

_QTY = T.DecimalType(18, 4)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _D, _L, _B, _TS = T.StringType(), T.DateType(), T.LongType(), T.BooleanType(), T.TimestampType()

SALES_LINE = _struct(
    channel=_S, doc_no=_L, item_no=T.IntegerType(), stock_id=_S, uom_id=_S, location_id=_S,
    doc_date=_D, qty=_QTY, amount=_QTY, unit_cost=_QTY, has_promo=_B,
)
STOCK_MASTER = _struct(
    stock_id=_S, uom_id=_S, base_uom_id=_S, uom_rate=_QTY, name=_S, active_ingredient=_S,
    barcode=_S, category_id=_S, brand_id=_S, ud1_code=_S, therapeutic_group=_S,
    cost=_QTY, reference_cost=_QTY, is_active=_S,
)
STOCK_BALANCE = _struct(stock_id=_S, uom_id=_S, location_id=_S, balance_qty=_QTY)
LOCATION = _struct(location_id=_S, name=_S, address=_S, is_active=_S)
CATEGORY = _struct(category_id=_S, description=_S)
BRAND = _struct(brand_id=_S, description=_S)
UOM = _struct(uom_id=_S, description=_S)
STOCK_LEDGER = _struct(
    stock_id=_S, uom_id=_S, location_id=_S, doc_type=_S, doc_date=_D,
    qty_out=_QTY, root_uom_qty_out=_QTY, unit_price=_QTY,
)
PURCHASE_ORDER_LINE = _struct(doc_id=_L, stock_id=_S, uom_id=_S)
SUPPLIER_INVOICE_LINE = _struct(
    doc_id=_L, doc_date=_D, location_id=_S, stock_id=_S, uom_id=_S, qty=_QTY,
    unit_price=T.DecimalType(20, 6), batch_remark=_S,
)
# supplier invoice, receipt, transit, credit and transfer lines in one frame
BATCH_LINE = _struct(
    doc_type=_S, doc_id=_L, location_id=_S, stock_id=_S, qty=_QTY, batch_remark=_S,
)
# the same lines with the day of their document
BATCH_LOG_LINE = T.StructType([*BATCH_LINE.fields, T.StructField("doc_date", _D)])
OUTLET_SKU = T.StructType(
    [T.StructField(n, _S) for n in ("location_id", "location_name", "stock_id", "stock_name")]
    + [T.StructField(f"qty_m{i}", _QTY) for i in range(1, 13)]
    + [
        T.StructField(n, _QTY)
        for n in (
            "total_12m", "outlet_ams", "current_balance", "days_of_inventory", "order_uom_rate",
            "reorder_point", "max_stock", "order_up_to_level", "outlet_trend_index",
            "pct_of_total", "velocity_daily", "outlet_cv",
        )
    ]
    + [T.StructField(n, T.IntegerType()) for n in ("safety_days", "outlet_safety_days")]
    + [
        T.StructField(n, _S)
        for n in (
            "reorder_recommendation", "outlet_demand_pattern", "outlet_momentum_status",
            "outlet_abc_class", "outlet_variability_class", "base_uom", "order_uom", "ud1_code",
            "demand_pattern", "variability_class", "abc_class", "gp_abc_class",
        )
    ]
    + [T.StructField("is_active", _B), T.StructField("last_updated", _D)]
)
STAFF = _struct(
    staff_id=_S, role=_S, pos_user_group=_S, is_active=_B, primary_outlet=_S,
    primary_outlet_name=_S, region=_S, allowed_outlets=T.ArrayType(_S),
    allowed_outlet_names=T.ArrayType(_S),
)
REVIEW_ACTIONS = _struct(stock_id=_S, action=_S, staff_id=_S, notes=_S, at=_TS)
PO_LOG = _struct(
    po_id=_S, supplier_id=_S, generated_at=_TS, generated_by=_S, item_count=_L,
    total_value=T.DoubleType(), total_qty=T.DoubleType(),
    items=T.ArrayType(_struct(
        stock_id=_S, order_qty=T.DoubleType(), unit_price=T.DoubleType(), line_total=T.DoubleType(),
    )),
    location_id=_S,
)

SCHEMAS = {
    "sales_line": SALES_LINE,
    "stock_master": STOCK_MASTER,
    "stock_balance": STOCK_BALANCE,
    "location": LOCATION,
    "category": CATEGORY,
    "brand": BRAND,
    "uom": UOM,
    "stock_ledger": STOCK_LEDGER,
    "purchase_order_line": PURCHASE_ORDER_LINE,
    "supplier_invoice_line": SUPPLIER_INVOICE_LINE,
    "batch_line": BATCH_LINE,
    "batch_log_line": BATCH_LOG_LINE,
    "outlet_sku": OUTLET_SKU,
    "staff": STAFF,
    "review_actions": REVIEW_ACTIONS,
    "po_log": PO_LOG,
}
