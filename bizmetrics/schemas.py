"""Entities: columns, defaults, limits, choices and keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def money(digits: int = 15) -> T.DecimalType:
    return T.DecimalType(digits, 2)


@dataclass(frozen=True)
class Entity:
    fields: tuple[tuple[str, T.DataType, bool], ...]  # name, type, required
    unique: tuple[str, ...] = ()
    max_length: dict[str, int] = field(default_factory=dict)
    choices: dict[str, dict[str, str]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    partition_by: str | None = None  # date column whose year lays out stored files
    digits: dict[str, int] = field(default_factory=dict)  # where a rule allows fewer than the type holds

    @property
    def schema(self) -> T.StructType:
        # Nullable throughout: whether a required value is there is a quality rule.
        return T.StructType([T.StructField(n, t, True) for n, t, _ in self.fields])

    @property
    def time(self) -> str | None:
        """The column that ranges of days refer to."""
        have = {n for n, _, _ in self.fields}
        return self.partition_by or next((c for c in ("month", "created_at") if c in have), None)

    @property
    def required(self) -> list[str]:
        return [n for n, _, needed in self.fields if needed]


# Codes and display labels.
PAYMENT_METHODS = {"cash": "نقدی", "card": "کارت بانکی", "transfer": "انتقال بانکی", "online": "پرداخت آنلاین"}
TRANSACTION_STATUS = {"pending": "در انتظار", "completed": "تکمیل شده", "cancelled": "لغو شده", "refunded": "بازگشت وجه"}
INVOICE_STATUS = {"draft": "پیش‌نویس", "sent": "ارسال شده", "paid": "پرداخت شده", "overdue": "تأخیر", "cancelled": "لغو شده"}
EXPENSE_STATUS = {"pending": "در انتظار", "approved": "تأیید شده", "rejected": "رد شده"}
UNITS = {"piece": "عدد", "kg": "کیلوگرم", "meter": "متر", "liter": "لیتر", "box": "جعبه"}
MOVEMENT_TYPES = {"in": "ورود به انبار", "out": "خروج از انبار", "return": "برگشت", "damage": "آسیب دیده"}
NO_CATEGORY = "بدون دسته"

#: Sign of a movement's quantity on the stock.
MOVEMENT_SIGN = {"in": 1, "return": 1, "out": -1, "damage": -1}

_text, _int, _long, _date, _ts, _bool = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.TimestampNTZType(), T.BooleanType())

ENTITIES: dict[str, Entity] = {
    "monthly_sales": Entity(
        fields=(
            ("month", _date, True),
            # A month rolled up from a large ledger needs more than 15 digits.
            ("revenue", money(25), True),
            ("transaction_count", _int, True),
            ("created_at", _ts, False), ("updated_at", _ts, False)),
        unique=("month",), digits={"revenue": 15}, defaults={"transaction_count": 0}),
    "sales_transaction": Entity(
        fields=(
            ("id", _long, True), ("transaction_id", _text, True), ("transaction_date", _ts, True),
            ("amount", money(), True), ("payment_method", _text, True), ("status", _text, True),
            ("customer_name", _text, False), ("customer_phone", _text, False),
            ("description", _text, False), ("created_at", _ts, False)),
        unique=("transaction_id",), partition_by="transaction_date",
        max_length={"transaction_id": 50, "payment_method": 20, "status": 20, "customer_name": 200, "customer_phone": 20},
        choices={"payment_method": PAYMENT_METHODS, "status": TRANSACTION_STATUS},
        defaults={"payment_method": "cash", "status": "completed"}),
    "sales_invoice": Entity(
        fields=(
            ("id", _long, True), ("invoice_number", _text, True), ("transaction_id", _long, False),
            ("issue_date", _date, True), ("due_date", _date, True),
            ("tax_amount", money(10), True), ("discount_amount", money(10), True),
            ("subtotal", money(), True), ("total_amount", money(), True), ("status", _text, True),
            ("notes", _text, False), ("created_at", _ts, False), ("updated_at", _ts, False)),
        unique=("invoice_number",), partition_by="issue_date",
        max_length={"invoice_number": 50, "status": 20},
        choices={"status": INVOICE_STATUS},
        defaults={"tax_amount": 0, "discount_amount": 0, "subtotal": 0, "status": "draft"}),
    "invoice_item": Entity(
        fields=(
            ("id", _long, True), ("invoice_id", _long, True), ("line", _int, True), ("description", _text, True),
            ("quantity", _int, True), ("unit_price", money(), True), ("discount", money(10), True), ("total", money(), True)),
        max_length={"description": 500}, defaults={"quantity": 1, "discount": 0}),
    "expense_category": Entity(
        fields=(
            ("id", _long, True), ("name", _text, True), ("description", _text, False),
            ("parent_category_id", _long, False), ("is_active", _bool, True),
            ("created_at", _ts, False), ("updated_at", _ts, False)),
        unique=("name",), max_length={"name": 100}, defaults={"is_active": True}),
    "expense": Entity(
        fields=(
            ("id", _long, True), ("title", _text, True), ("category_id", _long, False),
            ("amount", money(), True), ("date", _date, True), ("description", _text, False),
            ("receipt_image", _text, False), ("status", _text, True), ("created_by", _text, False),
            ("created_at", _ts, False), ("updated_at", _ts, False)),
        partition_by="date",
        max_length={"title": 200, "status": 20, "created_by": 100},
        choices={"status": EXPENSE_STATUS}, defaults={"status": "pending"}),
    "product": Entity(
        fields=(
            ("id", _long, True), ("product_code", _text, True), ("barcode", _text, False),
            ("name", _text, True), ("description", _text, False), ("category", _text, False),
            ("unit", _text, True), ("quantity", _int, True), ("unit_price", money(), True),
            ("reorder_level", _int, True), ("supplier", _text, False), ("location", _text, False),
            ("is_active", _bool, True), ("created_at", _ts, False), ("updated_at", _ts, False)),
        unique=("product_code",),
        max_length={"product_code": 50, "barcode": 100, "name": 200, "category": 100, "unit": 20,
                    "supplier": 200, "location": 100},
        choices={"unit": UNITS},
        defaults={"unit": "piece", "quantity": 0, "unit_price": 0, "reorder_level": 10, "is_active": True}),
    "inventory_movement": Entity(
        fields=(
            ("id", _long, True), ("product_id", _long, True), ("movement_type", _text, True),
            ("quantity", _int, True), ("reference_number", _text, False), ("description", _text, False),
            ("created_by", _text, False), ("created_at", _ts, True)),
        partition_by="created_at",
        max_length={"movement_type": 20, "reference_number": 100, "created_by": 100},
        choices={"movement_type": MOVEMENT_TYPES}),
}
