"""Declared schemas; readers never infer."""

from pyspark.sql import types as T

_TYPES = {
    "str": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "ts": T.TimestampNTZType(),
    "floats": T.ArrayType(T.FloatType()),
    "score": T.DecimalType(5, 2),
}


def struct(columns: str, nullable: bool = True) -> T.StructType:
    """``"a:str b:int"`` -> StructType."""
    fields = (item.split(":") for item in columns.split())
    return T.StructType([T.StructField(name, _TYPES[kind], nullable) for name, kind in fields])


# Tables of the analytical store
FLEET_TABLES = {
    "zones": struct(
        "zone_id:str zone_name:str city:str base_demand_per_hour:int vehicle_capacity:int "
        "latitude:double longitude:double"
    ),
    "vehicles": struct(
        "vehicle_id:str model:str city:str current_zone:str status:str battery_pct:int "
        "rides_today:int last_ride_at:str commissioned_date:date"
    ),
    "venue_events": struct(
        "event_id:str venue:str event_name:str event_type:str city:str zone:str "
        "expected_attendance:int event_date:date start_time:str end_time:str demand_multiplier:double"
    ),
    "rides": struct(
        "ride_id:str vehicle_id:str city:str pickup_zone:str dropoff_zone:str request_time:str "
        "pickup_time:str dropoff_time:str wait_time_min:double distance_miles:double fare_usd:double "
        "ride_status:str"
    ),
    "demand_forecasts": struct(
        "forecast_id:str zone_id:str city:str forecast_date:date hour:int predicted_demand:int "
        "predicted_supply:int demand_score:double confidence:double model_version:str"
    ),
    "telemetry": struct(
        "vehicle_id:str timestamp:ts latitude:double longitude:double heading_deg:double "
        "speed_mph:double battery_pct:int battery_range_mi:double motor_temp_f:double "
        "cabin_temp_f:double passenger_count:int lidar_status:str camera_status:str status:str zone:str",
        nullable=False,
    ),
}

# Operational tables
OPS_TABLES = {
    "fleet_actions": struct(
        "action_id:long action_type:str from_zone:str to_zone:str vehicle_count:int city:str "
        "reason:str priority:str status:str created_at:ts executed_at:ts"
    ),
    "surge_alerts": struct(
        "alert_id:long zone_id:str city:str event_name:str predicted_demand_score:score "
        "current_supply:int severity:str status:str recommended_action:str created_at:ts resolved_at:ts"
    ),
    "dispatch_overrides": struct(
        "override_id:long vehicle_id:str from_zone:str to_zone:str city:str reason:str "
        "override_by:str status:str created_at:ts"
    ),
    "workflows": struct(
        "workflow_id:long workflow_type:str trigger_source:str severity:str summary:str "
        "reasoning_chain:str entity_type:str entity_id:str status:str result_data:str created_at:ts "
        "completed_at:ts result_exception_id:long headline:str enriched_summary:str"
    ),
    "agent_actions": struct(
        "action_id:long action_type:str severity:str entity_type:str entity_id:str description:str "
        "action_taken:str status:str created_at:ts"
    ),
    "notes": struct("note_id:long entity_type:str entity_id:str note_text:str author:str created_at:ts"),
    "exceptions": struct(
        "exception_id:long entity_type:str entity_id:str exception_type:str severity:str "
        "description:str assigned_to:str status:str resolution:str created_at:ts resolved_at:ts"
    ),
    "chat_sessions": struct("session_id:str title:str created_at:ts updated_at:ts"),
    "chat_messages": struct(
        "message_id:long session_id:str role:str content:str metadata:str created_at:ts"
    ),
    "purchase_orders": struct(
        "po_id:long po_number:str supplier_facility_id:long destination_facility_id:long product_id:long quantity:int "
        "unit_cost_usd:double requested_date:date expected_date:date created_by:str status:str created_at:ts updated_at:ts"
    ),
    "shipment_tracking": struct(
        "tracking_id:long shipment_id:str status:str location_description:str latitude:double longitude:double "
        "temperature_f:double notes:str updated_by:str created_at:ts"
    ),
    "shipment_exceptions": struct(
        "exception_id:long shipment_id:str exception_type:str severity:str description:str assigned_to:str status:str "
        "resolution:str created_at:ts resolved_at:ts"
    ),
}

# Source tables the registered queries read
SOURCE_TABLES = {
    "region": struct("r_regionkey:int r_name:str"),
    "nation": struct("n_nationkey:int n_name:str n_regionkey:int"),
    "customer": struct("c_custkey:long c_name:str c_nationkey:int c_acctbal:double c_mktsegment:str"),
    "supplier": struct("s_suppkey:long s_name:str s_nationkey:int s_acctbal:double"),
    "part": struct("p_partkey:long p_name:str p_brand:str p_type:str p_size:int p_retailprice:double"),
    "orders": struct(
        "o_orderkey:long o_custkey:long o_orderstatus:str o_totalprice:double o_orderdate:ts "
        "o_orderpriority:str"
    ),
    "lineitem": struct(
        "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int l_quantity:double "
        "l_extendedprice:double l_discount:double l_tax:double l_returnflag:str l_linestatus:str "
        "l_shipdate:ts"
    ),
    "events": struct("event_id:long ts:ts user_id:long event_type:str value:double props:str"),
    "documents": struct("doc_id:long text:str lang:str source:str n_chars:long"),
    "embeddings": struct("vec_id:long embedding:floats label:int"),
    "pages": struct("page_id:long url:str html:str"),
    "benchmark": struct("item_id:long text:str"),
    "labels": struct("doc_id:long quality:int toxic:int"),
    "conversations": struct("conv_id:long turn:long role:str text:str"),
}

ALL_TABLES = {**FLEET_TABLES, **OPS_TABLES, **SOURCE_TABLES}

# One step of a workflow's reasoning chain, held as JSON text in the table
STEPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("step", T.IntegerType()),
            T.StructField("tool", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("output", T.StringType()),
            T.StructField("status", T.StringType()),
        ]
    )
)
