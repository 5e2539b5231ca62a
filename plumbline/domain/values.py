"""Fixed values of the domain: limits, keyword ladders and rule names, in their natural order."""

from __future__ import annotations

# Limits in metres and percent.
DOOR_WIDTH = 0.90
DOOR_HEIGHT = 2.05
CORRIDOR_WIDTH = 1.50
CORRIDOR_SLOPE = 3.0
SHORT_CORRIDOR = 10.0
SHORT_CORRIDOR_SLOPE = 4.0
TURNING_SPACE = 1.50
RAMP_SLOPE = 6.0
RAMP_WIDTH = 1.20
RAMP_RUN = 6.0

# Words of a space's text that tell its use, first match wins.
SPACE_USAGE = [
    ("corridor", ["corridor", "korridor", "flur", "hall", "gang"]),
    ("vestibule", ["vestibule", "vest."]),
    ("roof", ["roof"]),
    ("mechanical", ["mechanical"]),
    ("electrical", ["electrical"]),
    ("heating", ["heating"]),
    ("service", ["service", "shaft", "chase", "gfa", "volume"]),
    ("toilet", ["toilet", " wc", "rwc"]),
]
CORRIDOR_LIKE = ["corridor", "vestibule"]
EXCLUDED_SPACES = ["roof", "service", "mechanical", "electrical", "heating", "toilet"]

# Property names that carry semantics.
SEMANTIC_PROPERTIES = ["Category Description", "Name", "OmniClass Table 13 Category", "Reference"]

# Reason of a route for each route rule; other rules name their own reason.
ROUTE_REASONS = {
    "route_door_width": "door_width",
    "route_width": "route_width",
    "route_turning_space": "turning_space",
    "route_ramp_slope": "ramp_slope",
    "route_ramp_width": "ramp_width",
}

# Rules that are counted under another name.
RULE_ALIASES = {
    "missing_door_width": "missing",
    "route_door_width": "door_width",
    "route_turning_space": "turning_space",
    "route_ramp_slope": "ramp_slope",
    "route_ramp_width": "ramp_width",
}

# Rules of routes, of which a building's own list of issues is free.
ROUTE_RULE_IDS = [
    "route_door_width",
    "route_door_height",
    "route_width",
    "route_turning_space",
    "route_wall_block",
    "route_unreachable",
    "stair_block",
    "route_ramp_slope",
    "route_ramp_width",
    "route_ramp_run_length",
]
DOOR_HEIGHT_RULES = ["door_height", "missing_door_height", "route_door_height"]

# Words of a text that tell a gross area and a lift door.
GROSS_AREA = ["bruttoareal", "gross floor area", "gross area"]
LIFT = ["lift", "elevator", "hissi", "aufzug"]

# Names of the rules in sentences, in the order of their actions.
RULE_LABELS = {
    "door_width": "door too narrow",
    "corridor_width": "corridor too narrow",
    "route_width": "route too narrow",
    "turning_space": "turning space too small",
    "stair_block": "stair blocks route",
    "ramp_slope": "ramp too steep",
    "ramp_width": "ramp too narrow",
    "missing": "missing data",
    "unreachable": "route not connected",
}

# The action of each rule; a placeholder stands for a fact or its substitute.
ACTIONS = {
    "stair_block": "Reroute {edge} on {floor} from {start} to {end} so its polyline does not intersect the recorded stair geometry.",
    "door_width": "Increase the clear opening at {names|start}, then regenerate the route measurements and rerun SHACL.",
    "corridor_width": "Increase the measured clear width at {names|floor}, then regenerate the package and rerun SHACL.",
    "route_width": "Increase the measured clear width available along {edge} on {floor}, then regenerate the route measurement and rerun SHACL.",
    "turning_space": "Increase the clear turning area on {edge} on {floor}, then recompute the route before checking it again.",
    "ramp_slope": "Reduce the measured slope of {names|edge}, then regenerate its ramp measurement and rerun SHACL.",
    "ramp_width": "Increase the measured usable width of {names|edge}, then regenerate its ramp measurement and rerun SHACL.",
    "missing": "Add or repair the missing IFC geometry or property data for {names|elements}, then preprocess the model again.",
    "unreachable": "Check the IFC space-boundary and door relationships for {edge} on {floor}, then rebuild the door graph.",
}
SUBSTITUTES = {"edge": "the failed route", "floor": "the affected floor", "start": "its start door", "end": "its end door", "elements": "the affected IFC elements"}

# Types of stairs and of ramps.
STAIRS = ["IfcStair", "IfcStairFlight"]
RAMPS = ["IfcRamp", "IfcRampFlight"]
