"""Fixed values of the fleet data model: rosters, curves, pick lists, enumerations."""

# --- Fixed values: zone roster -------------------------------------------------
# zone_id, zone_name, city, base_demand_per_hour, vehicle_capacity, latitude, longitude
ZONES = [
    ("LV-STRIP", "Las Vegas Strip", "Las Vegas", 45, 12, 36.1147, -115.1728),
    ("LV-DOWNTOWN", "Downtown Las Vegas", "Las Vegas", 25, 8, 36.1699, -115.1398),
    ("LV-ARENA", "T-Mobile Arena District", "Las Vegas", 30, 10, 36.1590, -115.1485),
    ("LV-SPHERE", "Sphere District", "Las Vegas", 35, 10, 36.1582, -115.1520),
    ("LV-CONVENTION", "Convention Center District", "Las Vegas", 20, 6, 36.1290, -115.1530),
    ("SF-SOMA", "SoMa", "San Francisco", 40, 8, 37.7749, -122.3994),
    ("SF-MISSION", "Mission District", "San Francisco", 30, 6, 37.7599, -122.4148),
    ("SF-EMBARCADERO", "Embarcadero", "San Francisco", 35, 7, 37.7936, -122.3930),
    ("SF-CASTRO", "Castro", "San Francisco", 20, 4, 37.7609, -122.4350),
]

# --- Fixed values: venue roster ------------------------------------------------
# venue, city, zone, total_events, attendance low, attendance high
VENUES = [
    ("The Sphere", "Las Vegas", "LV-SPHERE", 90, 8000, 18000),
    ("T-Mobile Arena", "Las Vegas", "LV-ARENA", 51, 12000, 20000),
    ("Las Vegas Convention Center", "Las Vegas", "LV-CONVENTION", 12, 5000, 50000),
    ("Moscone Center", "San Francisco", "SF-SOMA", 6, 3000, 30000),
    ("Chase Center", "San Francisco", "SF-EMBARCADERO", 51, 15000, 18000),
]

# --- Fixed values: event types per venue, in pick order ------------------------
VENUE_EVENT_TYPES = {
    "The Sphere": ["concert", "experience", "special_event"],
    "T-Mobile Arena": ["hockey", "concert", "boxing", "ufc"],
    "Las Vegas Convention Center": ["convention", "trade_show", "expo"],
    "Moscone Center": ["tech_conference", "convention"],
    "Chase Center": ["basketball", "concert"],
}

# --- Fixed values: start hours and length in hours per event type ---------------
START_HOURS = {
    "concert": [19, 20],
    "experience": [14, 17, 19],
    "special_event": [18, 19, 20],
    "hockey": [17, 19],
    "boxing": [18, 20],
    "ufc": [18, 20],
    "convention": [9, 10],
    "trade_show": [9, 10],
    "expo": [9, 10],
    "tech_conference": [9, 10],
    "basketball": [17, 19],
}
DEFAULT_START_HOUR = 19
DURATIONS = {
    "concert": 3,
    "experience": 2,
    "special_event": 3,
    "hockey": 3,
    "boxing": 4,
    "ufc": 4,
    "convention": 8,
    "trade_show": 8,
    "expo": 8,
    "tech_conference": 8,
    "basketball": 3,
}
DEFAULT_DURATION = 3

# --- Fixed values: demand curve and request-hour weights, hour 0 to 23 ----------
HOUR_DEMAND = [
    0.20, 0.15, 0.10, 0.10, 0.15, 0.30, 0.50, 0.70, 0.80, 0.85, 0.80, 0.75,
    0.70, 0.75, 0.80, 0.85, 0.90, 1.00, 1.00, 0.95, 0.85, 0.70, 0.50, 0.30,
]
HOUR_REQUEST_WEIGHTS = [1, 1, 1, 1, 1, 2, 3, 4, 5, 5, 5, 5, 5, 5, 6, 7, 8, 9, 10, 10, 9, 7, 4, 2]
# The modulus is two more than the weights add up to; those two draws take hour 23.
HOUR_REQUEST_MODULUS = 118

# --- Fixed values: rides per day: (weekday, weekend), daily cap ------------------
CITY_BASE_RIDES = {"Las Vegas": (150, 180), "San Francisco": (100, 130)}
CITY_RIDE_CAP = {"Las Vegas": 500, "San Francisco": 350}

# --- Fixed values: vehicle pick list (active three times) ------------------------
VEHICLE_STATUS_PICKS = ["active", "active", "active", "idle", "charging", "maintenance", "en_route"]
VEHICLE_STATUS_WEIGHTS = [3, 3, 3, 2, 2, 1, 1]

# --- Fixed values: city code in the daily variation seed of the scaled build ------
CITY_CODES = {"Las Vegas": "lv", "San Francisco": "sf"}

# --- Fixed values: first day with a fare, forecast model label -------------------
PAID_FROM = "2025-12-01"
MODEL_VERSION = "v2.3"

# --- Fixed values: enumerations of the operational tables ------------------------
LEVELS = ["low", "medium", "high", "critical"]
ACTION_TYPES = ["rebalance", "surge_deploy", "recall", "charge_dispatch", "maintenance_pull"]
FLEET_ACTION_STATUSES = ["pending", "approved", "executed", "dismissed", "failed"]
ALERT_STATUSES = ["open", "acknowledged", "resolved", "dismissed"]
OVERRIDE_STATUSES = ["pending", "executed", "cancelled"]
AGENT_ACTION_STATUSES = ["pending", "executed", "dismissed", "failed"]
TRIGGER_SOURCES = ["monitor", "chat", "manual"]
WORKFLOW_STATUSES = ["in_progress", "pending_approval", "approved", "dismissed", "failed"]
EXCEPTION_STATUSES = ["open", "acknowledged", "resolved", "escalated", "cancelled"]
MESSAGE_ROLES = ["user", "assistant"]

# --- Fixed values: columns of the operational tables that must be filled -----------
NOT_NULL = {
    "fleet_actions": ["action_type", "from_zone", "to_zone", "vehicle_count", "city", "priority", "status"],
    "surge_alerts": ["zone_id", "city", "predicted_demand_score", "current_supply", "severity", "status"],
    "dispatch_overrides": ["vehicle_id", "from_zone", "to_zone", "city", "override_by", "status"],
    "workflows": ["workflow_type", "trigger_source", "severity", "summary", "reasoning_chain", "status"],
    "agent_actions": ["action_type", "severity", "description", "status"],
    "notes": ["entity_type", "entity_id", "note_text", "author"],
    "exceptions": ["entity_type", "entity_id", "exception_type", "severity", "description", "status"],
    "chat_sessions": ["session_id"],
    "chat_messages": ["session_id", "role", "content"],
    "purchase_orders": ["po_number", "status"],
    "shipment_tracking": ["shipment_id", "status"],
    "shipment_exceptions": ["shipment_id", "exception_type", "severity", "status"],
}

# --- Fixed values: defaults of the operational tables ------------------------------
DEFAULTS = {
    "fleet_actions": {"vehicle_count": 1, "reason": "", "priority": "medium", "status": "pending"},
    "surge_alerts": {
        "event_name": "",
        "predicted_demand_score": 0.0,
        "current_supply": 0,
        "severity": "medium",
        "status": "open",
        "recommended_action": "",
    },
    "dispatch_overrides": {"reason": "", "override_by": "operator", "status": "pending"},
    "workflows": {
        "trigger_source": "monitor",
        "severity": "medium",
        "reasoning_chain": "[]",
        "status": "in_progress",
    },
    "agent_actions": {"severity": "medium", "status": "pending"},
    "notes": {"author": "system"},
    "exceptions": {"severity": "medium", "status": "open"},
    "chat_sessions": {"title": "New conversation"},
    "chat_messages": {"metadata": "{}"},
    "purchase_orders": {"status": "draft"},
    "shipment_tracking": {},
    "shipment_exceptions": {"severity": "medium", "status": "open"},
}

# --- Fixed values: columns limited to an enumeration -------------------------------
ENUMS = {
    "fleet_actions": {"action_type": ACTION_TYPES, "priority": LEVELS, "status": FLEET_ACTION_STATUSES},
    "surge_alerts": {"severity": LEVELS, "status": ALERT_STATUSES},
    "dispatch_overrides": {"status": OVERRIDE_STATUSES},
    "workflows": {"trigger_source": TRIGGER_SOURCES, "status": WORKFLOW_STATUSES},
    "agent_actions": {"severity": LEVELS, "status": AGENT_ACTION_STATUSES},
    "notes": {},
    "exceptions": {"severity": LEVELS, "status": EXCEPTION_STATUSES},
    "chat_sessions": {},
    "chat_messages": {"role": MESSAGE_ROLES},
    "purchase_orders": {},
    "shipment_tracking": {},
    "shipment_exceptions": {"severity": LEVELS},
}

# --- Fixed values: supply workflow headlines, before an entity and without one -------
SUPPLY_HEADLINES = {
    "auto_reorder": ("Auto-Reorder: ", "Auto-Reorder Triggered"),
    "delay_response": ("Delay Response: Shipment ", "Delay Response"),
    "cold_chain_escalation": ("Cold Chain Alert: ", "Cold Chain Alert"),
}

# --- Fixed values: texts for which empty means none --------------------------------
EMPTY_IS_NULL = {"exceptions": ["assigned_to"], "shipment_exceptions": ["assigned_to"]}

# --- Fixed values: fields an exception report must bring; widths a caller may cut to --
EXCEPTION_REQUIRED = ["entity_type", "entity_id", "exception_type", "description"]
EXCEPTION_CUTS = {"description": 2000, "assigned_to": 100}

# --- Fixed values: target statuses a command may ask for -------------------------
ALERT_TARGETS = ["acknowledged", "resolved", "dismissed"]
ALERT_CLOSED = ["resolved", "dismissed"]
FLEET_ACTION_TARGETS = ["approved", "dismissed", "executed", "failed"]
FLEET_ACTION_STAMPED = ["approved", "executed"]
WORKFLOW_TARGETS = ["approved", "dismissed"]
EXCEPTION_TARGETS = ["acknowledged", "resolved", "escalated", "cancelled"]
EXCEPTION_CLOSED = ["resolved", "cancelled"]

# --- Fixed values: workflow headlines, reason of an approved action ---------------
WORKFLOW_HEADLINES = {
    "rebalancing_request": "Fleet Rebalancing: ",
    "surge_response": "Surge Response: ",
    "dispatch_override": "Dispatch Override: ",
}
HEADLINE_FALLBACK_ENTITY = "Fleet"
APPROVED_REASON = "Approved from workflow #"

# --- Fixed values: steps of a workflow without a chain of its own: tool, label ----
CHAIN_STEPS = [("monitor", "Trigger detected"), ("analyze", "Analyzing situation"), ("action", "Action on ")]

# --- Fixed values: title of a session without a user message ----------------------
NEW_SESSION_TITLE = "New conversation"

# --- Fixed values: follow-up suggestions: keywords, label, prompt ----------------
FOLLOWUPS = [
    (["weather"], "Check affected items", "List what the weather you looked up puts at risk."),
    (["reorder", "calculator"], "Create order", "Draft an order for the quantity you worked out."),
    (["forecast", "demand"], "Plan transfers", "Propose transfers that match the expected demand."),
]
