"""Raw extracts with fixed dates, small enough to read."""

from __future__ import annotations

ROWS = {
    "customers": [
        ("customer_id,first_name,last_name,email,phone,city,country,segment,signup_date,created_at,updated_at,is_deleted"),
        '1, Ana ,"Díaz ""la"" Uno",ANA@Example.COM ,,Bogotá,CO,Regular,2025-01-02,2025-01-02 10:00:00,2025-01-02 10:00:00,false',
        "1,Ana,Díaz,ana@example.com,,Bogotá,CO,Premium,2025-01-02,2025-01-02 10:00:00,2025-03-01 10:00:00.123,0",
        '2,Luis,"Pérez, Gómez",luis@example.com,300,"Lima\nNorte",PE,Business,abc,2025-01-02 10:00:00,2025-01-02 10:00:00,TRUE',
    ],
    "products": [
        "product_id,sku,product_name,category,unit_price,product_description,product_status,created_at,updated_at,is_deleted",
        "10,S-10,Rice,Food,2.005,,ACTIVE,2025-01-01 00:00:00,2025-01-01 00:00:00,false",
        "11,S-11,Soap,Home,3.50,,discontinued,2025-01-01 00:00:00,2025-01-01 00:00:00,true",
    ],
    "orders": [
        "order_id,customer_id,order_date,sales_channel,order_status,order_total,created_at,updated_at,is_deleted",
        "100,1,2025-02-01 12:00:00,Web,paid,9.01,2025-02-01 12:00:00,2025-02-01 12:00:00,false",
        "101,2,2025-02-02 12:00:00,app,delivered,3.50,2025-02-02 12:00:00,2025-02-02 12:00:00,false",
        "102,,2025-02-02 13:00:00,app,cancelled,0,2025-02-02 12:00:00,2025-02-02 12:00:00,true",
    ],
    "order_items": [
        "order_item_id,order_id,product_id,quantity,unit_price,line_total,created_at,updated_at,is_deleted",
        "1000,100,10, 2 ,2.00,4.00,2025-02-01 12:00:00,2025-02-01 12:00:00,false",
        "1001,100,11,1,5.00,5.00,2025-02-01 12:00:00,2025-02-01 12:00:00,",
        "1002,101,11,1,3.50,3.50,2025-02-02 12:00:00,2025-02-02 12:00:00,false",
        "1003,102,10,1,2.00,2.00,2025-02-02 12:00:00,2025-02-02 12:00:00,false",
    ],
    "payments": [
        "payment_id,order_id,payment_method,payment_status,amount,payment_date,created_at,updated_at,is_deleted",
        "500,100,PSE,approved,9.00,2025-02-01 12:05:00,2025-02-01 12:00:00,2025-02-01 12:05:00,false",
        "501,101,cash,pending,3.60,,2025-02-02 12:00:00,2025-02-02 12:05:00,false",
    ],
    "support_tickets": [
        "ticket_id,customer_id,subject,ticket_body,ticket_status,priority,created_at,updated_at,is_deleted",
        "900,1,Late,\"first line\nsecond, \"\"quoted\"\" line\",OPEN,High,2025-02-03 09:00:00,2025-02-03 09:00:00,false",
    ],
}


def write(folder) -> str:  # noqa: ANN001
    for name, lines in ROWS.items():
        (folder / f"{name}.csv").write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)
