"""Reading inputs and writing results."""

from seagrid.sources.models import StoredModel, load_model, save_model
from seagrid.sources.readers import (
    bathymetry_inventory, flatten_effort, file_listing, read_effort, read_features, read_readings,
    source_inventory,
)
from seagrid.sources.schemas import (
    EFFORT_FIELDS, READINGS, effort_payload_schema, effort_schema,
)
from seagrid.sources.writers import (
    LEAD_COLUMNS, write_daily, write_features, write_metrics,
)
