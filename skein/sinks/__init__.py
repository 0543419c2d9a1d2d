"""Writers of snapshots, logs and exports."""
